"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte-level BPE of 50,256 ranks; one base64 token and its rank a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary cuts text before merging (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of white space as that pattern sees them (the Unicode property; fixed values).
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Texts longer than this are given to the pattern in stretches, each from one end of a word to a later one ...
STRETCH = 1 << 16
_WORD_END = re.compile(f"(?<=[^{BLANK}])(?=[{BLANK}])")
#: ... and so long a run of white space is given to the merges as the one piece that the pattern makes of it.
_LONG_BLANK = re.compile(f"[{BLANK}]{{{STRETCH},}}")


@lru_cache(maxsize=4)
def encoding(vocabulary: str | bytes):
    """The tokenizer of a vocabulary file, given by its path or content, made once a process."""
    import tiktoken

    content = vocabulary if isinstance(vocabulary, bytes) else Path(vocabulary).read_bytes()
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(text: str | None, tokenizer) -> int:
    """Tokens of the whole text.

    No token goes from a word into white space after it, so a text may be cut at any end of a word without a change of
    its tokens; a stretch without one is never cut.  Of a run of white space the pattern takes all but the last character
    as one piece, which keeps to the next word, or all at the end of the text.
    """
    if not text:
        return 0
    if len(text) <= STRETCH:
        return len(tokenizer.encode_ordinary(text))
    total, at = 0, 0
    for run in _LONG_BLANK.finditer(text):
        total += _stretches(text[at : run.start()], tokenizer)
        at = run.end() - (run.end() < len(text))
        total += len(tokenizer._encode_single_piece(text[run.start() : at]))
    return total + _stretches(text[at:], tokenizer)


def _stretches(text: str, tokenizer) -> int:
    total, at = 0, 0
    while at < len(text):
        end = _WORD_END.search(text, min(at + STRETCH, len(text)))
        upto = end.start() if end else len(text)
        total += len(tokenizer.encode_ordinary(text[at:upto]))
        at = upto
    return total


def token_sizes(texts: DataFrame, text_id: str, text: str, *also: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(text id, the columns ``also``, n_tokens) for each row; missing and empty texts have 0 tokens. Texts are read whole.

    The vocabulary file is read once, by the driver, and broadcast (under 1 MB), so workers need no copy of it.
    """
    kept = [text_id, *also]
    schema = ", ".join(f"`{name}` {texts.schema[name].dataType.simpleString()}" for name in kept)
    content = texts.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = encoding(content.value)
        for batch in batches:
            sizes = [_count(x, tokenizer) for x in batch["_text"]]
            yield batch[kept].assign(n_tokens=sizes)

    return texts.select(*kept, F.col(text).alias("_text")).mapInPandas(count, f"{schema}, n_tokens long")
