"""Personal data: exact patterns for four kinds, and spans that a character-level BiLSTM-CRF adds to them.

The patterns' spans always stay. The tagger reads windows of a text that overlap by half. They are reconciled over the
whole text: each place takes its tag from the window in whose middle half it lies, the tags of all places form one
sequence, and spans are read from that, however many windows they cross. Those that overlap a pattern's span are left
out. Where a span is and of which kind is the tagger's decision; only numbers are checked (how many digits, their
checksum, octets), and that an address has one at sign and no white space. So windows that hold neither a digit nor a
place of a word with an at sign need no decoding: they are outside.

Defined results: a null text is empty and has no spans. Positions are code points, ends exclusive. Repeated rows give
repeated rows. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, texts
from .crf_tagger import KINDS, classes, decode, train

WINDOW = 96
FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
#: The patterns; possessive where a match from within the same run would fail or be longer from its start, so that time is linear.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = np.zeros(256, bool)
TRIGGER[[64, *range(48, 58)]] = True


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(number: str) -> bool:
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def fits(kind: str, text: str) -> bool:
    """Whether text passes its kind's rule; e-mail addresses have none beyond the pattern."""
    n = len(digits(text)) if kind in ("card", "phone") else 0
    return {"email": True, "ip": kind != "ip" or octets(text), "card": 13 <= n <= 19 and luhn(digits(text)), "phone": 9 <= n <= 15}[kind]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each at sign is looked at once, with the run of local characters before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.fullmatch(text[start - 1]):
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans by kind, then start."""
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if fits(kind, m[0])]
    return found


def plausible(kind: str, text: str) -> bool:
    """Whether the numbers of a tagged span are those of its kind."""
    if kind == "email":
        return text.count("@") == 1 and not text.startswith("@") and not re.search(r"\s", text)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and octets(".".join(parts))
    return fits(kind, text)


def watched(text: str) -> np.ndarray:
    """Places of digits and of the words that have an at sign."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    word = np.cumsum(space)
    signed = np.zeros(int(word[-1]) + 1 if len(word) else 1, bool)
    signed[word[codes == 64]] = True
    return np.flatnonzero(((codes >= 48) & (codes <= 57)) | (signed[word] & ~space))


def windows(n: int, at: np.ndarray) -> np.ndarray:
    """Starts of the windows of a text of n code points that hold one of the places ``at``."""
    half = WINDOW // 2
    last = max(0, -(-(n - WINDOW) // half))
    k = np.unique(np.concatenate([at // half, at // half - 1]))
    return half * np.unique(np.clip(k, 0, last))


def tagged_spans(found: list[tuple[int, np.ndarray]], lengths: list[int], tags: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """Spans of each text from its windows' tags, each place's from the window in whose middle half it lies."""
    out: list[list] = [[] for _ in lengths]
    k, quarter = 0, WINDOW // 4
    for who, starts in found:
        n = lengths[who]
        line = np.zeros(n, np.int8)
        for start in starts.tolist():
            row, k = tags[:, k], k + 1
            a = start + quarter if start else 0
            b = min(n, start + WINDOW - quarter) if start + WINDOW < n else n
            line[a:b] = row[a - start : b - start]
        kind = (line + 1) // 2  # 0 outside
        opens = (kind > 0) & ((line % 2 == 1) | (np.concatenate([[0], kind[:-1]]) != kind))
        edges = np.flatnonzero(opens | ((kind == 0) & (np.concatenate([[0], kind[:-1]]) > 0)))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), n]):
            if kind[a]:
                out[who].append((KINDS[kind[a] - 1], a, b))
    return out


def added_spans(text: str, base: list[tuple[str, int, int]], tagged: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The tagged spans that may stand and overlap no pattern's span. Tagged spans don't overlap, so both lists are swept in order."""
    taken = sorted((a, b) for _, a, b in base)
    kept, at, reach = [], 0, 0
    for kind, a, b in sorted(tagged, key=lambda s: s[1]):
        while at < len(taken) and taken[at][0] < b:
            reach, at = max(reach, taken[at][1]), at + 1
        if reach <= a and plausible(kind, text[a:b]):
            kept.append((kind, a, b))
    return kept


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_spans(column: pa.StringArray, model: dict[str, np.ndarray], most_windows: int = 2048) -> dict[int, tuple[list, list]]:
    """(pattern spans, added spans) of each row of the column that has a digit or an at sign."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    hits = np.flatnonzero(TRIGGER[data]) + offsets[0]
    out: dict[int, tuple[list, list]] = {}
    queue: list[tuple[int, str, np.ndarray, np.ndarray]] = []
    waiting = 0

    def flush() -> None:
        if not queue:
            return
        x = np.zeros((WINDOW, sum(len(q[3]) for q in queue)), np.int64)
        k = 0
        for _, _, codes, starts in queue:
            for s in starts.tolist():
                part = codes[s : s + WINDOW]
                x[: len(part), k] = part
                k += 1
        tags = np.concatenate([decode(model, x[:, a : a + most_windows]) for a in range(0, x.shape[1], most_windows)], 1)
        tagged = tagged_spans([(n, q[3]) for n, q in enumerate(queue)], [len(q[1]) for q in queue], tags)
        for (row, text, _, _), spans in zip(queue, tagged):
            base = base_spans(text)
            out[row] = base, added_spans(text, base, spans)
        queue.clear()

    for row in np.unique(np.searchsorted(offsets, hits, "right") - 1).tolist():
        text = column[row].as_py()
        codes = classes(text)
        starts = windows(len(text), watched(text))
        queue.append((row, text, codes, starts))
        waiting += len(starts)
        if waiting >= most_windows:
            flush()
            waiting = 0
    flush()
    return out


def personal_data(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Counts of the patterns' spans by kind, their digest, and all spans of each document."""
    small_batches(docs.sparkSession)
    model = model or train()
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, spans = np.zeros((len(KINDS), len(batch)), np.int64), [nothing] * len(batch), [""] * len(batch)
            for row, (base, added) in find_spans(batch["text"], model).items():
                for kind, _, _ in base:
                    counts[KINDS.index(kind), row] += 1
                digest[row] = hashlib.sha256(listed(base).encode()).hexdigest()
                spans[row] = listed(base + added)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, counts), pa.array(digest), pa.array(spans)], [x.split(" ")[0] for x in FOUND.split(", ")])

    return texts(docs).mapInArrow(run, FOUND)


def redact(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; overlapping spans become one, of the kind that starts first."""
    small_batches(docs.sparkSession)
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            column = batch.column(k)
            new = column.to_pylist()
            for row, (base, added) in find_spans(column.fill_null(""), model).items():
                text, parts, at = new[row], [], 0
                for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
                    if a >= at:
                        parts += [text[at:a], f"[{kind.upper()}]"]
                    at = max(at, b)
                new[row] = "".join([*parts, text[at:]])
            yield batch.set_column(k, "text", pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)
