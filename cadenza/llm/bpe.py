"""BPE encoding and decoding with a published vocabulary; merges by a segment tree over adjacent pair ranks."""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

NONE = 1 << 60
#: Pieces kept per worker; beyond it the memory is cleared and filled anew, so it stays bounded and results don't change.
CACHE = 300_000
#: White space to Python but not to the splitter.
SEPARATORS = re.compile("[\x1c-\x1f]")


def merge_symbols(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Merge adjacent symbols, always the pair of lowest rank and of those the leftmost, until no pair has a rank.

    ``merges`` maps a pair (first << 20 | second) to its rank and the merged symbol. A segment tree holds at each leaf
    the rank of the pair that begins there, with the place below it, so that a plain minimum at the root is the
    leftmost lowest. A merge changes three leaves, each updated in logarithmic time; merged-away symbols are skipped
    by links.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    get = merges.get
    if n == 2:
        hit = get(symbols[0] << 20 | symbols[1])
        return symbols if hit is None else [hit[1]]
    bits = (n - 2).bit_length()
    size, low = 1 << bits, (1 << bits) - 1
    tree = [NONE] * (2 * size)
    left, i = symbols[0], size
    for right in symbols[1:]:
        hit = get(left << 20 | right)
        if hit is not None:
            tree[i] = hit[0] << bits | (i - size)
        left = right
        i += 1
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    parts = symbols[:]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) < NONE:
        i = root & low
        j = after[i]
        merged = get(parts[i] << 20 | parts[j])[1]
        parts[i], parts[j] = merged, -1
        k = after[i] = after[j]
        h = before[i]
        if k < n:
            before[k] = i
            hit = get(merged << 20 | parts[k])
            tree[size + i] = NONE if hit is None else hit[0] << bits | i
            tree[size + j] = NONE
        else:
            tree[size + i] = NONE
        at = (size + i) >> 1
        if h >= 0:
            hit = get(parts[h] << 20 | merged)
            tree[size + h] = NONE if hit is None else hit[0] << bits | h
            side = (size + h) >> 1
            while side != at >> (at.bit_length() - side.bit_length()):
                a, b = tree[2 * side], tree[2 * side + 1]
                tree[side] = a if a < b else b
                side >>= 1
        side = (size + j) >> 1
        while side < size and side != at >> (at.bit_length() - side.bit_length()):
            a, b = tree[2 * side], tree[2 * side + 1]
            tree[side] = a if a < b else b
            side >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a < b else b
            at >>= 1
    return [p for p in parts if p >= 0]


# Letters and numbers of Latin-1, for the splitter's pattern.
LETTER, NUMBER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"


class WordBpe:
    """A tokenizer file of the BPE kind with word ends: its normaliser and splitter, and merges of our own.

    Pieces never span white space, so results are kept by runs between white space. Latin-1 texts are normalised and
    split by plain string functions; other texts by the file's own normaliser and splitter.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = self.vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {vocab[a] << 20 | vocab[b]: (i, vocab[a + b]) for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(re.escape(x) for x in sorted(self.specials, key=lambda x: (-len(x), x))) or "(?!)")
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        # The byte alphabet of byte-level tokenizers: printable bytes stand for themselves, the rest follow from 256.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = iter(range(256, 512))
        letters = [chr(b) if b in plain else chr(next(odd)) for b in range(256)]
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+").findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.runs: dict[str, tuple[int, str, str]] = {}

    def piece(self, data: bytes) -> list[int]:
        symbols = [self.first[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        return merge_symbols(symbols, self.merges)

    def run(self, run: str) -> tuple[int, str, str]:
        """Number of tokens, ids and tokens of a run of Latin-1 characters other than white space."""
        ids: list[int] = []
        for piece in self.split(run):
            known = self.pieces.get(piece)
            if known is None:
                known = tuple(self.piece(piece.encode()))
                if len(self.pieces) >= CACHE:
                    self.pieces.clear()
                self.pieces[piece] = known
            ids += known
        made = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        if len(self.runs) >= CACHE:
            self.runs.clear()
        self.runs[run] = made
        return made

    def _plain(self, text: str) -> list[tuple[int, str, str]]:
        try:
            text.encode("latin-1")
            simple = not SEPARATORS.search(text)
        except UnicodeEncodeError:
            simple = False
        if simple:
            known, run = self.runs.get, self.run
            return [known(r) or run(r) for r in text.lower().split()]
        ready = self.library.normalizer.normalize_str(text)
        byte_of = self.library.pre_tokenizer.pre_tokenize_str
        out = []
        for run in ready.split(" "):
            for piece, _ in byte_of(run) if run else ():
                symbols = [self.vocab[c] for c in piece]
                symbols[-1] = self.last[self.first.index(symbols[-1])]
                ids = merge_symbols(symbols, self.merges)
                out.append((len(ids), " ".join(map(str, ids)), self.decode(ids)))
        return out

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        """(number of tokens, their ids, the tokens) by parts of a text; the strings of special tokens are those tokens."""
        out: list[tuple[int, str, str]] = []
        at = 0
        for m in self.special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append((1, str(self.specials[m[0]]), m[0]))
            at = m.end()
        return out + self._plain(text[at:])

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by a blank, word ends included."""
        return " ".join(map(self.text_of.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of the ids and of the decoded text.

    A null or empty text has no tokens. Whole texts are encoded row by row in Arrow batches; repeated rows repeat;
    other columns are ignored. ``path`` names a tokenizer file that every machine has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        collecting = gc.isenabled()
        gc.disable()  # the caches hold no cycles, and looking for some takes longer than the merges
        try:
            for batch in batches:
                out: list[tuple] = []
                for text in batch.column(1).to_pylist():
                    parts = bpe.parts(text or "")
                    ids = " ".join([p[1] for p in parts]).encode()
                    back = " ".join([p[2] for p in parts]).encode("utf-8")
                    out.append((sum([p[0] for p in parts]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
                cols = list(zip(*out)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        finally:
            if collecting:
                gc.enable()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
