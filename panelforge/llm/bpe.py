"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

Texts go through in blocks. Special tokens are taken out of the raw text, what lies between them is normalised and cut
into pieces by the tokenizer's pattern, and pieces are merged in the alphabet of the byte-level step. Whole pieces are
remembered. A piece that is still growing beyond a fixed size is merged as far as it has come, and the tokens that nothing
to come can change are sent on, so memory is constant however long a piece is.

Which tokens are stable follows from the merge list (``sufficient_lookahead``). Let one string be merged twice with
different continuations. At any time the two runs agree left of some place, at first the end of what they share. That
place moves left only when a merge (u, v) with v at that place is done in one run alone, and then by the length of u. Where
each part of a merge comes from an earlier merge, ranks rise from one such move to the next, and the next v begins with u.
So no difference reaches further back than the heaviest chain of merges of rising rank, each right part beginning with the
left part before it, counting left parts; a pass over the merges finds it. One more character is held back, as the last
one of a piece has a mark of its own.

Normal forms, lower case and the classes of characters are asked of the tokenizer's own normaliser and pattern, once a
character or word. A stretch without a place to cut its normal form (marks on marks) is held until one comes.

Decoding is a machine over tokens: in the tokenizer's own form it puts a space between tokens; as bytes it undoes the
byte-level alphabet and carries incomplete characters from one call to the next.

Defined results: null and empty texts have no tokens and decode to the empty text. Repeated rows give repeated rows. Extra
columns are ignored; an empty table gives an empty result. Truncation and padding of the file are not used.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, texts

#: A fixed rule of byte-level vocabularies: visible Latin-1 bytes stand for themselves, the others are numbered from U+0100.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
TO_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(_HIDDEN)}
FROM_BYTE_LEVEL = {chr(256 + k): bytes([b]) for k, b in enumerate(_HIDDEN)} | {chr(b): bytes([b]) for b in _VISIBLE}
#: The tokenizer's pattern over stand-ins: a for letters, 0 for numbers, ! for other characters but spaces.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")
RUN = {"a": re.compile("[a-z]*"), "!": re.compile("[^ a-z0-9]*")}
#: Words of characters whose normal form is their lower case, without the start of a special token, and their pieces and the
#: breaks between words.
LATIN = re.compile("[!-;=-~À-ÖØ-öø-ÿ]+")
LATIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+|\n")
#: The pattern that both stand for, as vocabulary files write it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = re.compile(rb"[\t-\r ]")
BLOCK = 1 << 16
#: Up to so many symbols the least rank is looked for along the list, beyond it a queue has the ranks.
SHORT, NEVER = 64, (1 << 31) - 1
#: Pieces of at most so many symbols are merged many at once, in tables of so many rows.
TABLE, ROWS = 24, 2048


def sufficient_lookahead(merges: Iterable[tuple[str, str]]) -> int:
    """Characters after which no continuation changes a token."""
    heaviest: dict[str, int] = {}  # of chains whose last left part is the key
    most = 0
    for u, v in merges:
        before = max(heaviest.get(v[:k], 0) for k in range(1, len(v) + 1))
        weight = before + len(u)
        heaviest[u] = max(heaviest.get(u, 0), weight)
        most = max(most, weight)
    return most


@functools.cache
def _composing() -> frozenset[str]:
    """Characters that may join the one before them in a normal form."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<") | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


def begins_afresh(c: str) -> bool:
    """True if no normal form joins c to what stands before it."""
    return c < "̀" or not unicodedata.combining(c) and c not in _composing()


class Vocabulary:
    """The tables of a byte-level vocabulary file with word ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.ids, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: k for k, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        made = {}
        for k, (u, v) in enumerate(merges):
            if made.setdefault(u + v, k) != k or any(made.get(x, k) >= k and len(x.removesuffix(self.end)) > 1 for x in (u, v)):
                raise ValueError(f"merge {k} uses a token that no earlier merge makes, or makes one again: stability is not known")
        splits = content["pre_tokenizer"]["pretokenizers"]
        if splits[0]["pattern"]["Regex"] != PATTERN or model["dropout"] or any(t[x] for t in content["added_tokens"] for x in ("normalized", "lstrip", "rstrip", "single_word")):
            raise ValueError("a vocabulary of another pattern")
        self.lookahead = sufficient_lookahead((u, v.removesuffix(self.end)) if v != self.end else (u, v) for u, v in merges) + 1
        tokenizer = Tokenizer.from_file(path)
        self.normalise, self._cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        size = max(max(self.ids.values()), *self.special.values()) + 1
        self.texts: list[str | None] = [None] * size
        for token, k in (self.ids | self.special).items():
            self.texts[k] = token
        self.bytes = [t.encode() if t is not None else None for t in self.texts]
        # For many pieces at once: numbers of symbols, and pairs of them in order with their ranks and what they make.
        number = {t: k for k, t in enumerate(dict.fromkeys([*self.ids, *(x for m in merges for x in m)]))}
        byte = [chr(TO_BYTE_LEVEL.get(b, b)) for b in range(256)]
        for c in (*byte, *(c + self.end for c in byte)):
            number.setdefault(c, len(number))
        self.first, self.last = np.full(512, -1), np.full(512, -1)
        for c in byte:
            self.first[ord(c)], self.last[ord(c)] = number[c], number[c + self.end]
        self.of_number = np.array([self.ids.get(t, -1) for t in number])
        keys = np.array([number[u] << 32 | number[v] for u, v in merges], np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_ranks, self.made = keys[order], order.astype(np.int32), np.array([number[u + v] for u, v in merges], np.int32)
        self.kinds = {chr(c): chr(c) if chr(c).isalnum() or c in (32, 39) else " " if 9 <= c <= 13 else "!" for c in range(128)}

    def kind(self, c: str) -> str:
        """The stand-in of a character: itself if plain, else by the tokenizer's own pattern."""
        found = self.kinds.get(c)
        if found is None:
            pieces = self._cut("b" + c + c)
            found = " " if len(pieces) == 1 and pieces[0][0] == "b" else "a" if len(pieces) == 1 else "0" if len(pieces) == 3 else "!"
            self.kinds[c] = found
        return found

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) << 32 | right)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], NEVER)

    def merge_many(self, pieces: list[str]) -> list[bytes]:
        """The ids of whole pieces in the byte-level alphabet, a row of a table each: in a round each row merges its pair of
        least rank, the leftmost of equals, until none is left."""
        if len(pieces) > ROWS:  # tables of like widths, each small enough to stay in a core's cache
            order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
            found: list[bytes] = [b""] * len(pieces)
            for k in range(0, len(order), ROWS):
                for row, ids in zip(order[k : k + ROWS], self.merge_many([pieces[row] for row in order[k : k + ROWS]])):
                    found[row] = ids
            return found
        size = np.array([len(p) for p in pieces])
        width = int(size.max())
        table = np.full((len(pieces), width), -1, np.int32)
        inside = np.arange(width) < size[:, None]
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        table[inside] = self.first[codes]
        table[np.arange(len(pieces)), size - 1] = self.last[codes[np.cumsum(size) - 1]]
        out, rows, columns = table.copy(), np.arange(len(pieces)), np.arange(width)
        ranks = np.full((len(pieces), width), NEVER, np.int32)
        ranks[:, :-1] = self._ranks_of(table[:, :-1], table[:, 1:])
        while len(rows):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), at]
            going = least < NEVER
            if not going.all():
                out[rows[~going]] = table[~going]
                rows, table, ranks, at, least = rows[going], table[going], ranks[going], at[going], least[going]
            each = np.arange(len(rows))
            table[each, at] = self.made[least]
            moved = np.minimum(columns + (columns > at[:, None]), width - 1)
            table = np.take_along_axis(table, moved, 1)
            table[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(columns + (columns >= at[:, None]), width - 1), 1)
            ranks[:, -1] = NEVER
            after = np.where(at + 1 < width, table[each, np.minimum(at + 1, width - 1)], -1)
            ranks[each, at] = self._ranks_of(table[each, at], after)
            some = at > 0
            ranks[each[some], at[some] - 1] = self._ranks_of(table[each[some], at[some] - 1], table[each[some], at[some]])
        ids = np.where(out >= 0, self.of_number[out], -1)
        kept = ids >= 0
        ends = np.cumsum(kept.sum(1)).tolist()
        flat = ids[kept].astype("<u4").tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges by rank, the leftmost of equals first."""
        ranks, n = self.ranks, len(symbols)
        if n <= SHORT:
            open_ranks = [ranks.get(pair, NEVER) for pair in zip(symbols, symbols[1:])]
            while open_ranks and (r := min(open_ranks)) < NEVER:
                k = open_ranks.index(r)
                symbols[k] += symbols.pop(k + 1)
                open_ranks.pop(k)
                if k < len(open_ranks):
                    open_ranks[k] = ranks.get((symbols[k], symbols[k + 1]), NEVER)
                if k:
                    open_ranks[k - 1] = ranks.get((symbols[k - 1], symbols[k]), NEVER)
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, k, a, b) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(queue)
        while queue:
            _, k, a, b = heapq.heappop(queue)
            j = after[k]
            if symbols[k] != a or j >= n or symbols[j] != b:
                continue
            symbols[k], symbols[j] = a + b, ""
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (r := ranks.get((a + b, symbols[after[k]]))) is not None:
                    heapq.heappush(queue, (r, k, a + b, symbols[after[k]]))
            if (p := before[k]) >= 0 and (r := ranks.get((symbols[p], a + b))) is not None:
                heapq.heappush(queue, (r, p, symbols[p], a + b))
        return [s for s in symbols if s]


class Transducer:
    """Feed text in any portions; each call returns the ids that have become stable, as little-endian 32-bit numbers."""

    def __init__(self, vocabulary: Vocabulary, most_pieces: int = 300_000):
        self.v, self.known, self.most_pieces = vocabulary, {}, most_pieces
        self.limit = 2 * vocabulary.lookahead + 64
        self.longest_special = max(map(len, vocabulary.special), default=0)
        self.reset()

    def reset(self) -> None:
        self.raw, self.text, self.inside, self.tail = "", "", "", ""

    @property
    def held(self) -> int:
        """Characters kept from earlier calls."""
        return len(self.raw) + len(self.text) + len(self.tail)

    def feed(self, portion: str, final: bool = False) -> bytes:
        out: list[bytes] = []
        self.raw += portion
        while self.v.special:  # special tokens that stand in the raw text as a whole
            at, token = min(((k, -len(t)), t) for t in self.v.special if (k := self.raw.find(t)) >= 0) if any(t in self.raw for t in self.v.special) else (None, "")
            if not token:
                break
            self._normal(self.raw[: at[0]], True, out)
            out.append(self.v.special[token].to_bytes(4, "little"))
            self.raw = self.raw[at[0] + len(token) :]
        cut = len(self.raw)
        if not final:
            for k in range(1, min(self.longest_special, cut + 1)):
                if any(t.startswith(self.raw[cut - k :]) for t in self.v.special):
                    cut = len(self.raw) - k
            cut -= cut > 0  # the next character may be a mark on the last one
            while cut and not begins_afresh(self.raw[cut]):
                cut -= 1
        ready, self.raw = self.raw[:cut], self.raw[cut:]
        self._normal(ready, final, out)
        return b"".join(out)

    def _normal(self, ready: str, final: bool, out: list[bytes]) -> None:
        """Cuts what is ready into pieces; the last one may go on unless final."""
        text = self.text + (ready.lower() if ready.isascii() else self.v.normalise(ready))
        kinds, kind = self.v.kinds, self.v.kind
        shadow = text if text.isascii() else "".join([kinds[c] if c in kinds else kind(c) for c in text])
        if shadow is text and SPACE.search(text.encode()):
            shadow = re.sub("[\t-\r]", " ", text)
        at, n = 0, len(text)
        while at < n:
            if self.inside:
                end = RUN[self.inside].match(shadow, at).end()
                self._grow(text[at:end], out)
                at = end
                if at < n:
                    self._close(out)
                continue
            if shadow[at] == " ":
                at += 1
                continue
            end = PIECE.match(shadow, at).end()
            if final or end + 2 < n:
                out.append(self.piece(text[at:end]))
                at = end
            elif end == n and (shadow[at] != "'" or end - at > 3) and not shadow[at].isdigit():
                self.inside = "a" if shadow[at].isalpha() else "!"
            else:
                break
        self.text = text[at:]
        if final and self.inside:
            self._close(out)

    def piece(self, piece: str) -> bytes:
        """The ids of a whole piece."""
        found = self.known.get(piece)
        if found is None:
            if len(self.known) > self.most_pieces:
                self.known.clear()
            if len(piece) > self.limit:  # a long piece that came in one portion goes the same way in short ones
                out: list[bytes] = []
                for k in range(0, len(piece), self.limit):
                    self._grow(piece[k : k + self.limit], out)
                self._close(out)
                return b"".join(out)
            found = self.known[piece] = self._ids(self.symbols(piece), True)[0]
        return found

    @staticmethod
    def symbols(piece: str) -> str:
        """The piece in the byte-level alphabet."""
        return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(TO_BYTE_LEVEL)

    def _ids(self, symbols: str, final: bool) -> tuple[bytes, int]:
        """The ids of what is stable, and how many symbols they cover."""
        tokens = self.v.merge([*symbols[:-1], symbols[-1] + self.v.end] if final else [*symbols])
        ids, covered, out = self.v.ids, 0, []
        for token in tokens:
            if not final and covered + len(token) > len(symbols) - self.v.lookahead:
                break
            covered += len(token)
            if token in ids:
                out.append(ids[token].to_bytes(4, "little"))
        return b"".join(out), covered

    def _grow(self, part: str, out: list[bytes]) -> None:
        """Adds to the piece that is going on."""
        self.tail += self.symbols(part) if part else ""
        while len(self.tail) > self.limit:
            head = self.tail[: 8 * self.limit]
            ids, covered = self._ids(head, False)
            out.append(ids)
            self.tail = self.tail[covered:]
            if len(head) <= self.limit:
                break

    def _close(self, out: list[bytes]) -> None:
        if self.tail:
            out.append(self._ids(self.tail, True)[0])
        self.inside, self.tail = "", ""


class Encoder:
    """Encodes UTF-8 texts block by block. Words between spaces that it has met are remembered; a word longer than a block
    goes through a transducer in portions."""

    def __init__(self, vocabulary: Vocabulary, most_words: int = 300_000, longest: int = 64):
        self.stream, self.known, self.most, self.longest = Transducer(vocabulary), {}, most_words, longest

    def __call__(self, text: bytes) -> Iterator[bytes]:
        at, n = 0, len(text)
        while at < n:
            end = self._cut(text, at)
            if end - at <= BLOCK:
                words = text[at:end].split()
                if len(self.known) > self.most:
                    self.known.clear()
                known = self.known
                new = {w for w in words if w not in known}
                own = self._learn(new) if new else known
                yield b"".join([known[w] if w in known else own[w] for w in words])
                at = end
            else:
                portions = codecs.getincrementaldecoder("utf-8")()
                for k in range(at, end, BLOCK):
                    yield self.stream.feed(portions.decode(text[k : min(k + BLOCK, end)]))
                yield self.stream.feed("", True)
                self.stream.reset()
                at = end

    def many(self, texts: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
        """The portions of each text. Short texts are looked at in groups of about 16 blocks, so that new words are many at once."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            if len(text) > BLOCK:
                yield from self._group(group)
                yield self(text)
                group, size = [], 0
            else:
                group.append(text)
                size += len(text)
                if size > 16 * BLOCK:
                    yield from self._group(group)
                    group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[bytes]) -> Iterator[Iterator[bytes]]:
        lists = [text.split() for text in texts]
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        new = {w for words in lists for w in words if w not in known}
        own = self._learn(new) if new else known
        for words in lists:
            yield iter((b"".join([known[w] if w in known else own[w] for w in words]),))

    @staticmethod
    def _cut(text: bytes, at: int) -> int:
        """The end of the block that starts at a place: behind its last space, or at the end of a word that is longer."""
        if at + BLOCK >= len(text):
            return len(text)
        last = max(text.rfind(bytes([b]), at, at + BLOCK) for b in (32, *range(9, 14)))
        if last >= at:
            return last + 1
        found = SPACE.search(text, at + BLOCK)
        return found.end() if found else len(text)

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of new words: plain ones by their pieces, all in one text of a word a line, others through the transducer."""
        stream, latin = self.stream, LATIN.fullmatch
        if len(stream.known) > stream.most_pieces:
            stream.known.clear()
        plain, out = [], {}
        listed = list(words)
        for word, text in zip(listed, b"\n".join(listed).decode().split("\n")):
            if latin(text):
                plain.append(word)
            else:
                stream.reset()
                out[word] = stream.feed(text, True)
        stream.reset()
        found = stream.known
        lines = LATIN_PIECE.findall(b"\n".join([*plain, b""]).decode().lower())
        new = [p for p in dict.fromkeys(lines) if p not in found and p != "\n"]
        symbols = stream.symbols("\n".join(new)).split(chr(TO_BYTE_LEVEL[10]))
        short = [(p, x) for p, x in zip(new, symbols) if len(x) <= TABLE]
        if short:
            found.update(zip([p for p, _ in short], stream.v.merge_many([x for _, x in short])))
        parts, k = [], 0
        for p in lines:
            if p == "\n":
                out[plain[k]] = parts[0] if len(parts) == 1 else b"".join(parts)
                parts, k = [], k + 1
            else:
                parts.append(found[p] if p in found else stream.piece(p))
        longest = self.longest
        self.known.update(out if longest >= max(map(len, out)) else {w: ids for w, ids in out.items() if len(w) <= longest})
        return out


class Decoder:
    """Text of ids that come in any portions. ``plain``: tokens as they are, a space between them, as the tokenizer's own
    decoding has them; else the text that the tokens spell, a space for the mark of a word's end."""

    def __init__(self, vocabulary: Vocabulary, plain: bool = True):
        self.v, self.plain, self.begun = vocabulary, plain, False
        self.partial = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes, final: bool = False) -> bytes:
        """The UTF-8 of the text that has become complete."""
        tokens = np.frombuffer(ids, "<u4").tolist()
        if self.plain:
            words = [w for k in tokens if k < len(self.v.bytes) and (w := self.v.bytes[k]) is not None]
            lead, self.begun = b" " if self.begun and words else b"", self.begun or bool(words)
            return lead + b" ".join(words)
        out = []
        for k in tokens:
            token = self.v.texts[k] if k < len(self.v.texts) else None
            if token in self.v.special:
                out.append(token.encode())
            elif token is not None:
                word = token.removesuffix(self.v.end) if self.v.end else token
                out.append(b"".join([FROM_BYTE_LEVEL[c] for c in word]) + (b" " if word != token else b""))
        return self.partial.decode(b"".join(out), final).encode()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, portion (from 0) and ids: the tokens of each text in portions of a block; a text without tokens has an empty one."""
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(path))
        for batch in batches:
            for doc_id, portions in zip(batch["doc_id"], encoder.many(x.as_buffer().to_pybytes() for x in batch["text"])):
                for k, ids in enumerate(portions):
                    values = pa.array(np.frombuffer(ids, "<u4").astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), pa.array([k], pa.int32()), pa.ListArray.from_arrays([0, len(values)], values)], ["doc_id", "portion", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, portion int, ids array<int>")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the hashes of ids and of their decoded text, each taken portion by portion."""
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(path)
        encoder = Encoder(v)
        for batch in batches:
            rows = []
            for portions in encoder.many(x.as_buffer().to_pybytes() for x in batch["text"]):
                n, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(v)
                for ids in portions:
                    n += len(ids) // 4
                    of_ids.update(ids)
                    of_text.update(decoder.feed(ids))
                rows.append((n, of_ids.hexdigest(), of_text.hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c) for c in zip(*rows))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
