"""BPE encoding and decoding with forced-boundary splitting.

The vocabulary file (JSON of the public tokenizers library; the parameter ``path``) is read once on the driver
and broadcast; its size is that of the vocabulary. A text is split at special tokens, normalised (NFC, white
space runs to one space, lower case character by character) and cut into words by the file's pattern. A word is
a row of byte symbols, the last one marked as a word end. Two neighbouring symbols that are neighbours in no
vocabulary token can never be merged, nor can anything that spans them: there the word is cut, each fragment is
merged by rank on its own, and the ids are concatenated. Words repeat, so each worker keeps a bounded table of
those it has encoded; the words of a few hundred texts that it lacks are encoded side by side, in numpy: in each turn every
fragment merges its pair of least rank.

Decoding follows a file without a decoder: the tokens' strings joined by one space, special tokens included.

The normaliser is Python's; where its Unicode version is older than the library's, texts with marks
that are newer than it may be ordered differently (3 of 63,834 random texts of assigned code points), as may code points not assigned yet.
A file with another normaliser, a decoder or another kind of word pattern is refused (ValueError).

Defined cases: null is encoded as the empty text, which has no ids and decodes to the empty string; whole texts
are always encoded; an empty table gives an empty table; other columns of the input are not touched.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import pieces

#: Entries of a worker's table of encoded words, beside those of the texts at hand; a full one keeps only what these texts ask for, which changes no result.
KEPT_WORDS = 60_000
#: Bytes of text whose words are encoded together, one text at least.
TOGETHER = 1_000_000
#: Words of more code points are encoded one by one.
SIDE_BY_SIDE = 64
#: The only normaliser that ``Encoder`` knows: type, pattern and content of each step of the file.
NORMAL = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]


def byte_symbols() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for what follows U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """The parts of a tokenizer file that encoding needs; small (tens of thousands of entries), so it can be broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    model = spec["model"]
    steps = spec["normalizer"] and [(n["type"], n.get("pattern"), n.get("content")) for n in spec["normalizer"].get("normalizers", [spec["normalizer"]])]
    if steps != NORMAL or spec["decoder"] is not None or split["behavior"] != "Removed" or not split["invert"]:
        raise ValueError(f"a tokenizer file of another kind: normaliser {steps}, decoder {spec['decoder']}")
    return {
        "vocab": model["vocab"],
        "merges": [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]],
        "end": model["end_of_word_suffix"] or "",
        "pattern": split["pattern"]["Regex"],
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


class Encoder:
    """Encodes whole texts; made once in each task from the broadcast vocabulary."""

    def __init__(self, parts: dict):
        self.vocab, self.end, self.special = parts["vocab"], parts["end"], parts["special"]
        self.ranks = {m: i for i, m in enumerate(parts["merges"])}
        self.merged = [a + b for a, b in parts["merges"]]
        self.words = regex.compile(parts["pattern"])
        self.cuts = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.bytes = byte_symbols()
        self.inside = self._neighbours()
        self.marks = {(s,): (str(i), s) for s, i in self.special.items()}  # no word is a tuple
        self.by_word: dict[str | tuple[str], tuple[str, str]] = dict(self.marks)
        self._number()
        self.names = {i: t for t, i in (*self.vocab.items(), *self.special.items())}

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            token = token[: -len(self.end)]
            return [*token[:-1], token[-1] + self.end]
        return list(token)

    def _neighbours(self) -> set[tuple[str, str]]:
        """All pairs of symbols that stand side by side in some token; every other pair is a forced boundary."""
        found: set[tuple[str, str]] = set()
        for token in self.vocab:
            s = self._symbols(token)
            found.update(zip(s, s[1:]))
        return found

    def _number(self) -> None:
        """Symbols and tokens as whole numbers, symbols first, with merges as a sorted array of pairs."""
        number: dict[str, int] = {}
        plain, last = ([number.setdefault(b + end, len(number)) for b in self.bytes] for end in ("", self.end))
        self.plain, self.last, n = np.array(plain), np.array(last), len(number)
        self.joins = np.zeros((n, n), dtype=bool)  # False: a forced boundary
        for a, b in self.inside:
            if a in number and b in number:
                self.joins[number[a], number[b]] = True
        merges = [(number.setdefault(a, len(number)), number.setdefault(b, len(number)), r) for (a, b), r in self.ranks.items()]
        self.result = np.array([number.setdefault(t, len(number)) for t in self.merged], dtype=np.int64)
        self.base = len(number)
        pairs = np.array([a * self.base + b for a, b, _ in merges], dtype=np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_ranks = pairs[order], np.array([r for *_, r in merges], dtype=np.int64)[order]
        self.tokens = list(number)
        self.written = [str(self.vocab[t]) if t in self.vocab else None for t in self.tokens]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, the number of merges where it has none."""
        if not len(self.pairs):
            return np.full(len(a), len(self.merged))
        pair = a * self.base + b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], len(self.merged))

    def _side_by_side(self, words: list[str]) -> Iterator[tuple[str, str]]:
        """As ``word`` for each of the words, none of them empty."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        raw, none = np.frombuffer(b"".join(coded), dtype=np.uint8), len(self.merged)
        ends = np.cumsum([len(c) for c in coded])
        part = self.plain[raw]
        part[ends - 1] = self.last[raw[ends - 1]]
        cut = np.ones(len(part) + 1, dtype=bool)  # whether a fragment begins here
        cut[1:-1] = ~self.joins[part[:-1], part[1:]]
        cut[ends] = True
        rank = np.full(len(part), none)  # of a part and the one behind it in its fragment
        rank[:-1] = self._rank(part[:-1], part[1:])
        rank[cut[1:]] = none
        place, fragment = np.arange(len(part)), np.cumsum(cut[:-1])
        done = []
        while len(part):
            begin = np.flatnonzero(np.diff(fragment, prepend=0))
            least = np.repeat(np.minimum.reduceat(rank, begin), np.diff(begin, append=len(part)))
            going = least < none
            done.append((place[~going], part[~going]))
            part, place, fragment, rank, least = part[going], place[going], fragment[going], rank[going], least[going]
            at = np.flatnonzero(rank == least)
            at = at[np.diff(fragment[at], prepend=0) != 0]  # the leftmost in each fragment
            part[at] = self.result[rank[at]]
            stays = np.ones(len(part), dtype=bool)
            stays[at + 1] = False
            part, place, fragment, rank = part[stays], place[stays], fragment[stays], rank[stays]
            at -= np.arange(len(at))
            rank[at] = none
            left = np.concatenate([at, at[at > 0] - 1])
            left = left[left + 1 < len(part)]
            left = left[fragment[left] == fragment[left + 1]]
            rank[left] = self._rank(part[left], part[left + 1])
        place, part = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        until = np.searchsorted(place[order], ends).tolist()
        part = part[order].tolist()
        ids, tokens = [self.written[p] for p in part], [self.tokens[p] for p in part]
        begin = 0
        for end in until:
            yield " ".join(ids[begin:end]), " ".join(tokens[begin:end])
            begin = end

    def fragments(self, symbols: list[str]) -> list[tuple[str, ...]]:
        cuts = [i for i, pair in enumerate(zip(symbols, symbols[1:]), 1) if pair not in self.inside]
        return [tuple(symbols[a:b]) for a, b in zip([0, *cuts], [*cuts, len(symbols)])] if cuts else [tuple(symbols)]

    def merge(self, fragment: tuple[str, ...]) -> list[str]:
        """Merge the pair of least rank, leftmost first, until no pair has a rank."""
        if len(fragment) > 200:
            return self._merge_long(fragment)
        parts = list(fragment)
        none, rank = len(self.merged), self.ranks.get
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at : at + 2] = [self.merged[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), none)
        return parts

    def _merge_long(self, fragment: tuple[str, ...]) -> list[str]:
        """The same with a heap and a linked list, for fragments of any length in n log n steps."""
        import heapq

        parts: list[str | None] = list(fragment)
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def word(self, word: str) -> tuple[str, str]:
        """Ids and tokens of one word, each joined by spaces."""
        symbols = [self.bytes[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.end
        tokens = [t for f in self.fragments(symbols) for t in self.merge(f)]
        return " ".join([str(self.vocab[t]) for t in tokens]), " ".join(tokens)

    def _plain(self, text: str) -> list[str]:
        text = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text)) if not text.isascii() else text
        return self.words.findall(text.replace("Σ", "σ").lower())

    def _words(self, text: str) -> list[str | tuple[str]]:
        """The words of a whole text; a special token is a tuple."""
        out: list[str | tuple[str]] = []
        at = 0
        for m in self.cuts.finditer(text) if self.cuts else ():
            out += self._plain(text[at : m.start()])
            out.append((m.group(),))
            at = m.end()
        return out + self._plain(text[at:]) if at else self._plain(text)

    def encode_all(self, texts: list[str]) -> Iterator[tuple[str, str, int]]:
        """(ids joined by spaces, decoded text, number of ids) of each whole text."""
        words = [self._words(t) for t in texts]
        wanted = set().union(*words)
        if len(self.by_word) + len(wanted) > KEPT_WORDS:
            self.by_word = self.marks | {w: self.by_word[w] for w in wanted if w in self.by_word}
        lacking = list(wanted.difference(self.by_word))
        short = [w for w in lacking if len(w) <= SIDE_BY_SIDE]
        self.by_word.update(zip(short, self._side_by_side(short)) if short else ())
        long = {w: self.word(w) for w in lacking if len(w) > SIDE_BY_SIDE}
        known = self.by_word | long if long else self.by_word
        for found in words:
            if not found:
                yield "", "", 0
                continue
            ids, tokens = map(" ".join, zip(*map(known.__getitem__, found)))
            yield ids, tokens, ids.count(" ") + 1

    def encode(self, text: str) -> tuple[str, str, int]:
        """As ``encode_all`` for one text."""
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", what: str = "digest") -> DataFrame:
    """One row per document: id, n_tokens, and with what='digest' ids_sha256 and decoded_sha256, with 'ids' the ids themselves."""
    parts = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    digest = what == "digest"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(parts.value)
        for batch in pieces(batches, "text", TOGETHER):
            n, a, b = [], [], []
            for ids, decoded, k in encoder.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                n.append(k)
                if digest:
                    a.append(hashlib.sha256(ids.encode()).hexdigest())
                    b.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                else:
                    a.append([int(x) for x in ids.split()])
            columns = [batch.column(0), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(a), pa.array(b)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"]) if digest else pa.RecordBatch.from_arrays([*columns, pa.array(a, pa.list_(pa.int32()))], ["id", "n_tokens", "ids"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each row of ids; null ids give the empty text."""
    vocabulary = load_vocabulary(path)
    names = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in (*vocabulary["vocab"].items(), *vocabulary["special"].items())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names.value
        for batch in batches:
            texts = [" ".join(known[i] for i in ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    slim = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
