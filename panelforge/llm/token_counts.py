"""Token counts: whole texts are encoded once and their tokens attributed to sections by character offsets.

A text is encoded as one piece, so counts are those of the text as a model sees it. The vocabulary is byte-level: tokens
cover the bytes in order, and the sums of their lengths are their offsets. Token spans and section spans of a text are
both sorted, and their interval join is a binary search of one in the other, in the row's own task; nothing is shuffled.

A token that crosses a section boundary goes, by ``rule``, to the section of its first character ("first"), of its last
("last"), or to the section that holds most of its characters, the earliest of equals ("most"). A section's tokens add
up to the text's under every rule. A character belongs to the token that holds its first byte.

Defined results: null and empty texts have one empty section without tokens. Repeated rows give repeated rows. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SECTIONS = "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long"


def load_vocabulary(path: str):
    """The encoding of a .tiktoken file and the byte length of each token."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        lengths[k] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(ends: np.ndarray, bounds: np.ndarray, data: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section. ends: token ends, bounds: section starts and the end of the text, both in bytes."""
    starts = np.concatenate([[0], ends])[:-1]
    begins = data & 0xC0 != 0x80  # the first bytes of characters
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    owner = last.copy() if rule == "last" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        for k in crossing:
            cut = np.clip(bounds[first[k] : last[k] + 2], starts[k], ends[k])
            owner[k] += np.argmax([begins[a:b].sum() for a, b in zip(cut[:-1], cut[1:])])
    n = len(bounds) - 1
    return np.bincount(owner, minlength=n), np.bincount(first[crossing], minlength=n)


def token_counts(rows: DataFrame, fields: tuple[str, ...] = ("text",), vocabulary: str | None = None, rule: str = "first", break_at: str = "\n") -> DataFrame:
    """Tokens of each section of each row's text.

    With one field the sections are its lines, each with its line break. With several, the text is the fields joined by
    ``break_at`` and the sections are the fields, each with the break after it."""
    if rule not in ("first", "last", "most"):
        raise ValueError(f"unknown rule {rule!r}")
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    small_batches(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = load_vocabulary(vocabulary)
        gap = break_at.encode()
        for batch in batches:
            out: list[list[np.ndarray]] = []
            ids = batch["doc_id"].to_pylist()
            for k, parts in enumerate(zip(*(batch[f].to_pylist() for f in fields))):
                text = break_at.join(parts)
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                if len(fields) > 1:
                    bounds = np.cumsum([0, *(len(p.encode()) + len(gap) for p in parts[:-1]), len(parts[-1].encode())])
                else:
                    cuts, at = [0], raw.find(gap)
                    while at >= 0:
                        cuts.append(at + len(gap))
                        at = raw.find(gap, at + len(gap))
                    bounds = np.array(cuts if cuts[-1] == len(raw) and len(cuts) > 1 else [*cuts, len(raw)])
                ends = np.cumsum(lengths[np.array(encoding.encode_ordinary(text), np.int64)])
                n_tokens, n_crossing = attribute(ends, bounds, data, rule)
                chars = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])[bounds]
                n = len(bounds) - 1
                out.append([np.full(n, k), np.arange(n), chars[:-1], chars[1:], n_tokens, n_crossing])
            if out:
                who, *columns = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in who], pa.int64()), *map(pa.array, columns)], [x.split(" ")[0] for x in SECTIONS.split(", ")])

    return rows.select("doc_id", *(F.coalesce(f, F.lit("")).alias(f) for f in fields)).mapInArrow(count, SECTIONS)
