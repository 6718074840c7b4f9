"""SentencePiece merge-type encoding and decoding.

A text is encoded by walking over it with the longest pieces that match (found by an Aho-Corasick
automaton). A piece may follow another only if the two, joined and merged again from single
characters, come back as these two pieces; otherwise the next shorter match is tried, and a position
from which nothing fits is marked in a bitfield and never tried again. Since compatibility of
neighbours decides the merge result, the walk gives what the library gives. Where pieces of equal
rank overlap (runs of spaces), the merge itself decides.

Nulls count as the empty text, which has no ids and decodes to the empty text. Repeated rows give
repeated results; columns other than the text are passed through whatever their names, except that ones
named like the new columns are replaced. Of merges of equal rank the leftmost goes first, as in the library. Very long texts are
encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import held, slices

#: Words, and parts of words, whose ids a Python worker remembers before it forgets those not used lately.
REMEMBERED = 300_000
#: Pairs of neighbours of which a worker remembers whether they fit.
PAIRS = 200_000
SPACE = "▁"
#: A word with marks behind it.
MARKED = re.compile(r"(▁?[^\W_]+)([^\w▁]+)")


class PieceModel:
    """The pieces of a model file, with an encoder and a decoder of our own."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.rank = {p: (-sp.get_score(i)) for p, i in self.ids.items()}
        #: Characters that stand side by side in some piece; between others no piece reaches across.
        self.joins = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(pair[1] == SPACE != pair[0] for pair in self.joins):
            raise ValueError("a piece has a space after another character, so words can't be encoded apart")
        held = Counter(r for p, r in self.rank.items() if len(p) > 1)
        if any(held[r] > 1 and len(p) > 1 and p.strip(SPACE) for p, r in self.rank.items()):
            raise ValueError("pieces other than spaces share a rank")
        #: What an id adds to the decoded text; control ids and the unknown id add what the library prints.
        self.said = ["" if sp.is_control(i) else " ⁇ " if sp.is_unknown(i) else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.value = {i: b for b, i in self.bytes.items()}
        self.control = [sp.is_control(i) for i in range(n)]
        #: For decode_all(): the texts of ids, and the ids whose text depends on their neighbours.
        self.table = pa.array([chr(self.value[i]) if self.value.get(i, 128) < 128 else x for i, x in enumerate(self.said)], pa.string())
        self.hard = np.array([self.value.get(i, 0) >= 128 or sp.is_control(i) for i in range(n)])
        self.fits: dict[tuple[str, str], bool] = {}
        self.fits_before: dict[tuple[str, str], bool] = {}
        #: Pieces that come back whole when merged from their characters; pairs are remembered with these strings, not with parts of a text.
        self.whole = {p: p for p in self.ids if self.merge(p) == [p]}
        self.longest = ahocorasick.Automaton()
        for p in self.whole:
            self.longest.add_word(p, len(p))
        self.longest.make_automaton()
        #: The next shorter piece that begins a piece; in the end its first character, piece or not.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in self.whole), p[0]) for p in self.whole if len(p) > 1}
        self.words: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}  # those of the turn before
        self.parts: dict[str, bytes] = {}
        self.parts_before: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces of a text by merging the best-ranked neighbours, leftmost first."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue = [(self.rank[p], k, p) for k in range(len(parts) - 1) if (p := text[k : k + 2]) in self.rank]
        heapq.heapify(queue)
        while queue:
            _, k, p = heapq.heappop(queue)
            if parts[k] is None or (r := after[k]) < 0 or parts[k] + parts[r] != p:
                continue
            parts[k], parts[r], after[k] = p, None, after[r]
            if after[k] >= 0:
                before[after[k]] = k
                if (q := p + parts[after[k]]) in self.rank:
                    heapq.heappush(queue, (self.rank[q], k, q))
            if (b := before[k]) >= 0 and (q := parts[b] + p) in self.rank:
                heapq.heappush(queue, (self.rank[q], b, q))
        return [p for p in parts if p is not None]

    def compatible(self, left: str, right: str) -> bool:
        """Whether two pieces stay as they are when their characters are merged again."""
        if (found := self.fits_before.pop((left, right), None)) is None:
            found = self.merge(left + right) == [left, right]
        if len(self.fits) >= PAIRS:
            self.fits_before, self.fits = self.fits, {}
        self.fits[self.whole.get(left, left), self.whole.get(right, right)] = found
        return found

    def walk(self, text: str) -> list[str]:
        """The pieces of a text by longest matches with backtracking; the merge itself for tied spaces."""
        if SPACE * 2 in text:
            return self.merge(text)
        n = len(text)
        if n == 1 or text in self.whole:
            return [text]
        fits, shorter, matches = self.fits, self.shorter, self.longest.iter_long
        done: list[str] = []
        failed = 0  # bit k: no way on from position k
        at, last, ahead = 0, "", matches(text)
        while at < n:
            end, size = next(ahead, (n, 0))
            piece: str | None = text[at : end + 1] if end + 1 - size == at else text[at]
            while True:
                if piece is None:  # nothing fits here: a shorter piece before it
                    failed |= 1 << at
                    piece = done.pop()
                    at -= len(piece)
                    last = done[-1] if done else ""
                elif not failed >> at + len(piece) & 1:
                    if not last:
                        break
                    if (fit := fits.get((last, piece))) is None:
                        fit = self.compatible(last, piece)
                    if fit:
                        break
                piece = shorter.get(piece)
            done.append(piece)
            at += len(piece)
            last = piece
            if end + 1 != at < n:  # not where the matches went on
                ahead = matches(text, at)
        return done

    def cut(self, word: str) -> list[str]:
        """The word in parts between which no piece reaches."""
        joins = self.joins
        if (m := MARKED.fullmatch(word)) and word[m.end(1) - 1 : m.end(1) + 1] not in joins:
            return [m[1], m[2]]
        if word.isalpha() or word[1:].isalpha():
            return [word]
        out, a = [], 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in joins:
                out.append(word[a:k])
                a = k
        return [*out, word[a:]]

    def part_ids(self, part: str) -> bytes:
        found: list[int] = []
        for piece in self.walk(part):
            if (i := self.ids.get(piece)) is not None:
                found.append(i)
            else:
                found += [self.bytes.get(b, self.unknown) for b in piece.encode()]
        return array("i", found).tobytes()

    def word_ids(self, word: str) -> bytes:
        """The ids of a word, as bytes."""
        out = b""
        for part in self.cut(word):
            if (ids := self.parts.get(part)) is None:
                if (ids := self.parts_before.pop(part, None)) is None:
                    ids = self.part_ids(part)
                if len(self.parts) >= REMEMBERED // 2:
                    self.parts_before, self.parts = self.parts, {}
                self.parts[part] = ids
            out += ids
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encoded(text), np.int32)

    def encoded(self, text: str | None) -> bytes:
        """All ids of a text, as bytes; a space is put before it, and each word is encoded with the space before it."""
        if not text:
            return b""
        known, parts = self.words, (" " + text).replace(SPACE, " ").split(" ")[1:]
        if "" in parts:  # runs of spaces belong to the word after them
            joined, gap = [], ""
            for p in parts[:-1]:
                if p:
                    joined.append(gap + p)
                    gap = ""
                else:
                    gap += " "
            parts = [*joined, gap + parts[-1]]
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            pass
        if len(known) >= REMEMBERED:
            self.words_before, self.words = known, {}
            known = self.words
        before = self.words_before
        for p in set(parts).difference(known):
            known[p] = before.pop(p) if p in before else self.word_ids(SPACE + p.replace(" ", SPACE))
        return b"".join(map(known.__getitem__, parts))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: without the space before it, and with bytes read as UTF-8."""
        out, held = [], bytearray()
        for i in ids:
            if (b := self.value.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(text_of(held))
                held.clear()
            out.append(self.said[i])
        text = "".join(out) + text_of(held)
        first = next((i for i in ids if not self.control[i]), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """decode() for many: by a table look-up for each id where bytes over 127 don't occur."""
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        texts = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.table.take(lists.values)), "")
        texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
        odd = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(self.hard[flat])])[offsets]))
        if len(odd):
            own = np.zeros(len(texts), bool)
            own[odd] = True
            texts = pc.replace_with_mask(texts, pa.array(own), pa.array([self.decode(flat[offsets[k] : offsets[k + 1]].tolist()) for k in odd], pa.string()))
        return texts


def text_of(raw: bytearray) -> str:
    """UTF-8 with one replacement character for each byte that isn't part of a character."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        good = raw[: e.start].decode()
        return good + "�" + text_of(raw[e.start + 1 :])


def model(path: str) -> PieceModel:
    return held(("pieces", path), lambda: PieceModel(path))


def encode_texts(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs without its text, with the ids of the text and the text that the ids decode to.

    docs' other columns stay as they are, except that ones named like the two new columns are replaced.
    """
    keep = [c for c in docs.columns if c not in (text, ids, decoded)]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("array<int>").alias(ids), F.lit(None).cast("string").alias(decoded)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in slices(batches, 256):
            found = [m.encoded(t) for t in batch.column(len(keep)).to_pylist()]
            offsets = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(found), np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists, m.decode_all(lists)], names=[*keep, ids, decoded])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)


def digests(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """doc_id, the number of ids and SHA-256 digests of the ids and of the decoded text."""
    return encoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))
