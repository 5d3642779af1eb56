"""Templates of the license scan. Statements, standard headers, whole short licenses and heads of long ones, as published."""

from __future__ import annotations

_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _gnu_header(license: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {license} as published by the Free
    Software Foundation, either version {version} of the License, or (at your option) any later version."""


#: Statements, headers and texts by license.
TEMPLATES = {
    "0BSD": (f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_WARRANTY}",),
    "AGPL-3.0": (_gnu_header("GNU Affero General Public License", "3"),),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at""",
        """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed
        with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License,
        Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at""",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", f"{_BSD_CONDITIONS} {_BSD_WARRANTY}"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_WARRANTY}"),
    "BSL-1.0": (
        """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
        http://www.boost.org/LICENSE_1_0.txt)""",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal.",),
    "EPL-2.0": (
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available
        at https://www.eclipse.org/legal/epl-2.0/""",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        _gnu_header("GNU General Public License", "2"),
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2
        as published by the Free Software Foundation.""",
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _gnu_header("GNU General Public License", "3")),
    "ISC": (
        "Released under the ISC License.",
        f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}""",
    ),
    "LGPL-2.1": (_gnu_header("GNU Lesser General Public License", "2.1"),),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        _gnu_header("GNU Lesser General Public License", "3"),
    ),
    "MIT": ("Released under the MIT License.", f"{_MIT_GRANT} {_MIT_REST}", _MIT_GRANT),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
        or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
        any means.""",
    ),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
        be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
        the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
        not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
}

#: First paragraphs of license files whose text is too long for a template.
HEADS = {
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International Public License",
    "CC0-1.0": "Creative Commons Legal Code CC0 1.0 Universal",
    "EPL-2.0": "Eclipse Public License - v 2.0",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MPL-2.0": "Mozilla Public License Version 2.0",
}

#: Short identifiers that stand for a license besides its name: ending "-only" or "-or-later".
_GNU = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
TAGS = {name: (name, *([f"{name}-only", f"{name}-or-later", f"{name}+"] if name in _GNU else [])) for name in TEMPLATES}
