"""Chunks that a page break has cut in two, put together again.

Whether a chunk goes on in the next one depends on all that has been put together so far, so a document's chunks are read one after
another: they come sorted, and a task holds the open chunk alone, however long a document is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An open chunk of more characters takes nothing more.
MOST = 3000
#: What the open chunk and the next one show where a rule joins them, by rule.
BLOCKS = (
    (r"class\s+\w+.*:\s*$", r"^\s*(def\s+\w+|@\w+|\w+\s*=)"),
    (r"def\s+\w+.*:\s*$", r"^\s*(\"\"\".*?\"\"\"|'''.*?'''|[a-zA-Z_]\w*)"),
    (r"try:\s*$", r"^\s*(except|finally|else)"),
    (r"(if|for|while)\s+.*:\s*$", r"^\s*[a-zA-Z_]"),
    (r"@\w+\s*$", r"^\s*def\s+\w+"),
    (r">>>\s*[^>]*$", r"^[^>].*"),
)
CODE = r"^\s*(def|class|import|from|if|for|while|try|with)\b|>>>|print\s*\("
CLASS_BODY = (r"class\s+\w+.*:\s*$", r"^\s*(def\s+\w+|@\w+|\w+\s*=|\"\"\")")
FUNCTION_BODY = (r"def\s+\w+.*:\s*$", r"^\s*[a-zA-Z_\"'@]")
METHOD = r"__\w+__\s*\([^)]*\):\s*This is called|def\s+\w+\s*\([^)]*\):\s*This|__\w+__\s*\([^)]*\):\s*$|:\s*This is called\s*$"
MEMBER = r"(setter|getter|property|descriptor|method)\s*\.?\s*$"
ITEM, NEXT_ITEM = r"^\s*[\d\-\*•]\s+.*[^.!?]\s*$", r"^\s*[\d\-\*•]"
HEADER = r"^[A-Z][A-Za-z\s]+$"
OUTPUT = r"\$\s+python|\$\s+pip|>>>|Ran \d+ test|(OK|FAILED|ERROR)\s*$"
#: What stands between the parts, and the kind of the whole (None: that of the first part), by rule.
JOINTS = {
    "split_code_block": ("\n", "Code"),
    "split_class_function": ("\n", "Code"),
    "incomplete_sentence": (" ", None),
    "method_continuation": (" ", "Concept"),
    "list_continuation": ("\n", None),
    "topic_continuation": ("\n\n", None),
    "terminal_output": ("\n", "Code"),
}


def _shows(pattern: str, text: str, flags: int = 0) -> bool:
    return re.search(pattern, text, re.MULTILINE | flags) is not None


def _closes(first: str, second: str) -> bool:
    """Whether brackets left open in code are closed by what follows."""
    pairs = [(first.count(o) - first.count(c), second.count(c) - second.count(o)) for o, c in ("()", "[]", "{}")]
    return _shows(CODE, first) and any(left > 0 and over > 0 for left, over in pairs)


def _topic_goes_on(first: str, second: str) -> bool:
    heads = re.findall(HEADER, first, re.MULTILINE)
    words = [w for w in heads[-1].lower().split() if len(w) > 3] if heads else []
    return any(w in second.lower() for w in words) and not _shows(HEADER, second)


def joint(first: str, second: str) -> str | None:
    """The first rule, in order, by which two stripped texts belong together."""
    if not first or not second or len(first) > MOST:
        return None
    lower = re.match("[a-z]", second) is not None

    def body() -> bool:
        return _shows(FUNCTION_BODY[0], first) and _shows(FUNCTION_BODY[1], second) and not _shows(r"^def\s+", second)

    def method() -> bool:
        return (lower or re.match("whenever|when|if|to|for", second, re.IGNORECASE) is not None) and _shows(METHOD, first, re.IGNORECASE)

    def item() -> bool:
        return re.match(NEXT_ITEM, second) is not None and re.search(ITEM, first.split("\n")[-1].strip()) is not None

    found = {  # looked at in order, each rule only where none before it holds
        "split_code_block": lambda: any(_shows(a, first) and _shows(b, second) for a, b in BLOCKS) or _closes(first, second),
        "split_class_function": lambda: (_shows(CLASS_BODY[0], first) and _shows(CLASS_BODY[1], second)) or body(),
        "incomplete_sentence": lambda: first.endswith((":", "is called")) or (lower and first[-1] not in ".!?"),
        "method_continuation": lambda: method() or (re.match("[A-Z]", second) and re.search(MEMBER, first, re.IGNORECASE)),
        "list_continuation": lambda: item() or ("descriptor protocol:" in first.lower() and re.search(r"__\w+__.*:", second)),
        "topic_continuation": lambda: _topic_goes_on(first, second),
        "terminal_output": lambda: re.match(OUTPUT, second) or re.match(OUTPUT, first),
    }
    return next((rule for rule in JOINTS if found[rule]()), None)


SCHEMA = "document string, chunk_id bigint, page bigint, last_page bigint, chunk_type string, merge_type string, parts bigint, text string"


def _merged(frames: Iterator[pd.DataFrame], least: int = 0) -> Iterator[pd.DataFrame]:
    names = ["document", "chunk_id", "page", "last_page", "chunk_type", "merge_type", "parts", "text"]
    held = None
    for frame in frames:
        done = []
        for document, chunk, page, kind, text in zip(*(frame[c] for c in ("document", "chunk_id", "page", "chunk_type", "text")), strict=True):
            if len(text) < least:
                continue
            rule = joint(held[7].strip(), text.strip()) if held and held[0] == document else None
            if rule is None:
                if held:
                    done.append(held)
                held = [document, chunk, page, page, kind, None, 1, text]
            else:
                between, whole = JOINTS[rule]
                held = [*held[:3], page, whole or held[4], rule, held[6] + 1, held[7].strip() + between + text.strip()]
        if done:
            yield pd.DataFrame(done, columns=names)
    if held:
        yield pd.DataFrame([held], columns=names)


def merge_split_chunks(chunks: DataFrame, least: int = 0) -> DataFrame:
    """Chunks with those that go on in the next one put together, in chains: id, page and kind of the first part, page of the last, the
    last rule that joined, and the number of parts. Null texts count as empty and join nothing; chunks without a document are
    each for themselves. Chunks of less than ``least`` characters leave first; that is looked at where a text has been computed, as
    a condition of Spark's would compute it once more. chunks: (document, chunk_id, page, chunk_type, text)."""
    rows = chunks.select("document", "chunk_id", F.col("page").cast("bigint").alias("page"), "chunk_type", F.coalesce("text", F.lit("")).alias("text"))
    alone = rows.where(F.col("document").isNull() & (F.length("text") >= least)).select("document", "chunk_id", "page", F.col("page").alias("last_page"), "chunk_type", F.lit(None).cast("string").alias("merge_type"), F.lit(1).cast("bigint").alias("parts"), "text")
    ordered = rows.where("document is not null").repartition("document").sortWithinPartitions("document", "page", "chunk_id")
    return ordered.mapInPandas(lambda frames: _merged(frames, least), SCHEMA).unionByName(alone)
