"""Lexical retrieval packing: documents into sequences of at most ``SEQ`` tokens, with BM25 neighbours.

Tokens: the ids of a public tokenizer file, then one end id. The ids are exact. For vocabularies with word ends no token
crosses white space, so each distinct piece of a word is merged once, in numpy; words with other than ASCII and Latin-1
letters go through the tokenizer itself, and so does everything for files of other kinds.

Full stretches of SEQ tokens become sequences of their own where the text is read. The remainders (under SEQ tokens each)
go to shards of about ``SHARD_TOKENS`` tokens, whatever the size of the corpus, by a lexical key: each has the token of
the lowest rank in a fixed order that favours rare ones (weighted min-hash), so two remainders have the same key as
often as their weighted sets of tokens overlap. Keys with few tokens share a shard, keys with many are parted into several; their
sizes are counted first, at most one row for each token of the vocabulary. A shard holds a BM25 inverted
index of its remainders. A seed (the first unused one) opens a sequence; its unused neighbours by BM25 fill it in order of
score, the last one cut where the sequence is full; what is cut off is the next seed. So only the last sequence of a
shard is short. Neighbours in other shards aren't seen: README says how many that loses.

Nulls: a null text is empty and is its end id. Rows are packed as they are, so repeated rows and ids
are packed again; null ids are carried through. An empty table gives no pieces. Extra columns are
ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEQ, END, SHARD_TOKENS, K1, B, POWER, PORTION, COMMON = 2048, 1, 1 << 20, 1.2, 0.75, 3.0, 1 << 21, 4
TOKENIZER = "word_bpe_49k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NEVER = (1 << 31) - 1
_BLANK, _LETTER, _DIGIT, _SIGN, _QUOTE, _FOREIGN = range(6)
_KIND = np.full(256, _FOREIGN, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[39] = _QUOTE
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class WordTokens:
    """Exact token ids of texts, piece by piece, for a lower-casing byte-level BPE with word ends.

    Texts are lower-cased and cut into pieces as arrays of bytes, a whole portion at once; each distinct piece is
    merged once and remembered: when there are more than ``cache_pieces`` of them, the less frequent half is forgotten,
    and all if they have more than ``cache_bytes``.
    """

    def __init__(self, path: str, cache_pieces: int = 200_000, cache_bytes: int = 1 << 25):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.n_ids = max(vocab.values()) + 1
        letters = _byte_letters()
        self.alone = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + "</w>"] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[a] << 17 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # an open hash of the pairs: one probe as a rule
        bits = 18
        self.mask = (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.full(1 << bits, NEVER, np.int32)
        left, self.probes = np.arange(len(key)), 0
        while len(left):
            at = self._slot(key[left], self.probes)
            free = self.slot_key[at] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slot_key[at[put]], self.slot_rank[at[put]] = key[left[put]], left[put]
            left = left[~put]
            self.probes += 1
        self.limit, self.limit_bytes = cache_pieces, cache_bytes
        self._forget()

    def _forget(self) -> None:
        """Only the end of a text is known: it stands before the pieces, as entry 0."""
        self.known, self.seen = pa.array([], pa.binary()), np.zeros(1, np.int64)
        self.ids, self.start, self.size = np.array([END], np.int32), np.zeros(1, np.int32), np.ones(1, np.int32)

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        return ((key * 0x2545F4914F6CDD1D >> 29) + probe * ((key * 0x9E3779B1 >> 11) | 1)) & self.mask

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of symbols, NEVER if there is no such merge."""
        key = left.astype(np.int64) << 17 | right
        at = self._slot(key, 0)
        held = self.slot_key[at]
        out = np.where(held == key, self.slot_rank[at], NEVER)
        todo = np.flatnonzero((held != key) & (held >= 0))
        for probe in range(1, self.probes):
            if not len(todo):
                break
            at = self._slot(key[todo], probe)
            held = self.slot_key[at]
            hit = held == key[todo]
            out[todo[hit]] = self.slot_rank[at[hit]]
            todo = todo[~hit & (held >= 0)]
        return out

    def merge(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in one array, number per piece) of pieces of so many bytes each, merged by rank, all at once."""
        sym = self.alone[raw].astype(np.int32)
        last = np.cumsum(size) - 1
        sym[last] = self.final[raw[last]]
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
        pair = np.full(len(sym), NEVER, np.int32)  # of each symbol with the next one of its piece
        pair[:-1] = self._ranks(sym[:-1], sym[1:])
        pair[last] = NEVER
        done_sym, done_own = [], []
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(pair, begin)
            mine = np.repeat(best, np.diff(np.append(begin, len(sym))))
            over = mine == NEVER
            if over.any():  # nothing left to merge in these pieces
                done_sym.append(sym[over])
                done_own.append(owner[over])
                live = ~over
                sym, owner, pair, mine = sym[live], owner[live], pair[live], mine[live]
                if not len(sym):
                    break
            at = np.flatnonzero(pair == mine)
            close = np.diff(at) == 1
            if close.any():  # runs of overlapping hits (aaa): every second one, from the left
                run = np.concatenate([[True], ~close])
                within = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[within % 2 == 0]
            sym[at] = self.made[mine[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, owner, pair = sym[keep], owner[keep], pair[keep]
            at = at - np.arange(len(at))  # where the merged ones are now; only their pairs have changed
            redo = np.concatenate([at, at[at > 0] - 1])
            inner = redo + 1 < len(sym)
            pair[redo[~inner]] = NEVER
            redo = redo[inner]
            same = owner[redo] == owner[redo + 1]
            pair[redo[~same]] = NEVER
            redo = redo[same]
            pair[redo] = self._ranks(sym[redo], sym[redo + 1])
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        sym, owner = np.concatenate(done_sym), np.concatenate(done_own)
        order = np.argsort(owner, kind="stable")
        return sym[order], np.bincount(owner, minlength=len(size))

    def _add(self, pieces: pa.Array) -> None:
        """Learns the ids of new pieces: plain ones are merged, words with quotes or other letters go through the tokenizer."""
        raw, ends = _flat(pieces)
        held = np.diff(ends, prepend=0)
        other = _others(raw, ends)
        plain = np.ones(len(pieces), bool)
        plain[other] = False
        ids, count = self.merge(raw[np.repeat(plain, held)] if len(other) else raw, held[plain])
        size, start = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        size[plain], start[plain] = count, np.cumsum(count) - count
        if len(other):
            enc = self.tokenizer.encode_batch([w.decode("utf-8") for w in pieces.take(pa.array(other)).to_pylist()], add_special_tokens=False)
            extra = [np.array(e.ids, np.int32) for e in enc]
            size[other] = [len(e) for e in extra]
            start[other] = len(ids) + np.cumsum(size[other]) - size[other]
            ids = np.concatenate([ids, *extra])
        base = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        self.start, self.size = np.concatenate([self.start, (start + base).astype(np.int32)]), np.concatenate([self.size, size.astype(np.int32)])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, each followed by the end id; where each text ends)."""
        data, ends = _flat(texts)
        pieces, per_text = _pieces(data, ends)
        if len(data) + self.known.nbytes >= 1 << 31:  # more than an array of pieces can hold
            self._forget()
        known = len(self.known)
        # known pieces first: they keep their places, and what follows them is new
        coded = pa.chunked_array([self.known, pieces]).dictionary_encode().chunk(1) if known and len(pieces) else pieces.dictionary_encode()
        if len(pieces):
            self.known = coded.dictionary
        if len(self.known) > known:
            self._add(self.known.slice(known))
        # the end of each text counts as one more piece
        closing = np.cumsum(per_text) + np.arange(len(per_text))
        inner = np.ones(len(pieces) + len(per_text), bool)
        inner[closing] = False
        rows = np.zeros(len(inner), np.int32)
        rows[inner] = np.frombuffer(coded.indices.buffers()[1], np.int32, len(pieces)) + 1
        size = self.size[rows]
        stop = np.cumsum(size, dtype=np.int64)
        at = np.repeat(self.start[rows] - (stop - size).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        flat = self.ids[at]
        self.seen = np.bincount(rows, minlength=len(self.size)) + np.pad(self.seen, (0, len(self.size) - len(self.seen)))
        if len(self.known) > self.limit or self.known.nbytes > self.limit_bytes:
            self._keep(self.limit // 2)
        return flat, stop[closing]

    def _keep(self, n: int) -> None:
        """Forgets all pieces but the n that were seen most; what they were seen counts half from now on."""
        if not n or self.known.nbytes > self.limit_bytes:
            return self._forget()
        kept = np.sort(np.argpartition(-self.seen[1:], n)[:n])
        self.known = self.known.take(pa.array(kept))
        kept = np.append(0, kept + 1)
        size = self.size[kept]
        stop = np.cumsum(size, dtype=np.int32)
        self.ids = self.ids[np.repeat(self.start[kept] - (stop - size), size) + np.arange(stop[-1], dtype=np.int32)]
        self.start, self.size, self.seen = stop - size, size, self.seen[kept] // 2


class PlainTokens:
    """Ids of texts by the tokenizer itself, for files of other kinds."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.n_ids = self.tokenizer.get_vocab_size()

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        enc = self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        ids = [np.array([*e.ids, END], np.int32) for e in enc]
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.cumsum([len(x) for x in ids], dtype=np.int64)


def tokens_of(path: str) -> WordTokens | PlainTokens:
    """The reader of a tokenizer file. It and what it has learned are kept in the worker, for its later tasks."""
    if path not in _READERS:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        words = whole["model"].get("end_of_word_suffix") == "</w>" and "Lowercase" in json.dumps(whole.get("normalizer"))
        _READERS.clear()
        _READERS[path] = WordTokens(path) if words else PlainTokens(path)
    return _READERS[path]


_READERS: dict[str, WordTokens | PlainTokens] = {}


def _flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text ends) of an Arrow array of strings; null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, ends[1:] - ends[0]


def _pieces(raw: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(pieces in order, number per text). Words of ASCII and Latin-1 letters are lower-cased and cut into runs of
    letters, single digits and runs of signs; words with a quote, other characters or <| stay whole, as they are."""
    if not len(raw):
        return pa.array([], pa.binary()), np.zeros(len(ends), np.int64)
    kind, low = _KIND[raw], _LOW[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3)
    if len(latin):
        after = raw[latin + 1]
        letter = (after != 0x97) & (after != 0xB7)
        kind[latin[letter]] = kind[latin[letter] + 1] = _LETTER
        low[latin + 1] += ((after < 0x9F) & letter).astype(np.uint8) * 32
    begins = np.zeros(len(raw), bool)
    starts = np.concatenate([[0], ends[:-1]])
    begins[starts[starts < len(raw)]] = True
    solid = kind != _BLANK
    word = solid.copy()
    word[1:] &= ~solid[:-1] | begins[1:]
    first = word.copy()
    first[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    first &= solid
    odd = kind >= _QUOTE
    odd[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)
    odd = np.flatnonzero(odd)
    if len(odd):
        at = np.flatnonzero(word)
        bad = np.unique(np.searchsorted(at, odd, "right") - 1)
        gap = np.flatnonzero(~solid | word)  # a word ends at the next blank or word
        stop = np.append(gap, len(raw))[np.searchsorted(gap, at[bad], "right")]
        size = stop - at[bad]
        inside = np.repeat(at[bad] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        first[inside] = False
        first[at[bad]] = True
        low[inside] = raw[inside]
    body = low[solid]
    offsets = np.append(np.flatnonzero(first[solid]), len(body)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    upto = np.concatenate([np.zeros(1, np.int32), np.cumsum(first, dtype=np.int32)])[ends]
    return found, np.diff(upto, prepend=0)


def _others(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which pieces (bytes in one array, where each ends) are words for the tokenizer itself: those with <| or other than
    ASCII signs without the quote and Latin-1 letters."""
    bad = _KIND[raw] >= _QUOTE
    if bad.any():  # most are Latin-1 letters: a lead byte and one that follows it in the same piece
        lead, tail = raw == 0xC3, (raw & 0xC0) == 0x80
        after = np.concatenate([[False], lead[:-1]])
        after[ends[:-1]] = False
        bad &= ~lead & ~tail
        bad |= (tail != after) | after & ((raw == 0x97) | (raw == 0xB7))
        bad[ends - 1] |= lead[ends - 1]
    sign = np.concatenate([[False], (raw[:-1] == 60) & (raw[1:] == 124)])
    sign[ends[:-1]] = False
    return np.unique(np.searchsorted(ends, np.flatnonzero(bad | sign), "right"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Bm25:
    """An inverted index over the remainders of a shard. Terms of many of them are rows with a place for each remainder
    instead: adding rows up costs less, and they have at most ``COMMON`` times as many places as their terms have entries."""

    def __init__(self, docs: list[np.ndarray], k1: float = K1, b: float = B):
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        pair, tf = np.unique(np.concatenate(docs).astype(np.int64) * len(docs) + owner, return_counts=True)
        term, self.doc = pair // len(docs), pair % len(docs)
        self.terms, begin, df = np.unique(term, return_index=True, return_counts=True)
        self.begin, self.end = begin, begin + df
        size = np.array([len(d) for d in docs], np.float64)
        idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        self.weight = np.repeat(idf, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * (size / size.mean())[self.doc]))
        self.n = len(docs)
        often = df * COMMON > self.n
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), self.n))
        often = np.repeat(often, df)
        self.rows[np.repeat(self.row, df)[often], self.doc[often]] = self.weight[often]

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every document for the distinct terms of the query."""
        at = np.searchsorted(self.terms, np.unique(query))
        row = self.row[at]
        at = at[row < 0]
        lo, hi = self.begin[at], self.end[at]
        size = hi - lo
        rows = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(self.doc[rows], weights=self.weight[rows], minlength=self.n) + self.rows[row[row >= 0]].sum(axis=0)


def pack_shard(docs: list[np.ndarray], seq: int = SEQ) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents shorter than seq."""
    index, unused, out = Bm25(docs), np.ones(len(docs), bool), []
    number = first = 0
    seed, at = -1, 0  # the seed and where it goes on
    while True:
        if seed < 0:
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                return out
            seed, at = first, 0
            unused[seed] = False
        size = len(docs[seed]) - at
        out.append((seed, at, size, number, 0))
        room, rest, score, near = seq - size, (-1, 0), None, ()
        while room:
            if not len(near):
                near = np.flatnonzero(unused)
                if not len(near):
                    break
                # each takes a token at least: a few do as a rule, and as many as there are places always
                most = room if score is not None else min(room, 64)
                score = index.scores(docs[seed]) if score is None else score
                if len(near) > most:
                    near = _nearest(score, near, most)
                near = near[np.argsort(-score[near], kind="stable")].tolist()
                near.reverse()
            k = near.pop()
            take = min(room, len(docs[k]))
            out.append((k, 0, take, number, seq - room))
            unused[k] = False
            room -= take
            if take < len(docs[k]):
                rest = (k, take)
        number += 1
        seed, at = rest


def _nearest(score: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """The n of `among` (ascending) with the highest scores; of equal scores the first ones."""
    s = score[among]
    edge = np.partition(s, len(s) - n)[len(s) - n]
    keep = s > edge
    tied = np.flatnonzero(s == edge)
    keep[tied[: n - int(keep.sum())]] = True
    return among[keep]


def priorities(n_ids: int, seed: int = 11) -> np.ndarray:
    """A rank for every token id. A document's key is its token of the lowest rank: weighted min-hash, with
    weights that grow as tokens get rarer (merge vocabularies list frequent ones first)."""
    u = np.random.default_rng(seed).random(n_ids)
    weight = np.log1p(np.arange(n_ids) / 512.0) ** POWER
    return np.argsort(np.argsort(-np.log(u) / np.maximum(weight, 1e-9), kind="stable")).astype(np.int32)


def shards_of(tokens: dict[int, int], shard_tokens: int) -> list[tuple[int, int, int]]:
    """(key, first shard, number of shards) of keys with so many tokens each: small ones share a shard, large ones get several."""
    out, shard, held = [], 0, 0
    for key, n in sorted(tokens.items()):
        many = -(-n // shard_tokens)
        if many > 1 or held + n > shard_tokens:
            shard, held = shard + (held > 0), 0
        out.append((key, shard, many))
        if many > 1:
            shard += many
        else:
            held += n
    return out


def _tokenized(documents: DataFrame, path: str, seq: int) -> DataFrame:
    """Full stretches (key is null, no ids), and remainders with their ids, key and a number that parts equal ones."""
    schema = "doc_id long, start long, length long, crc long, doc_tokens long, key int, salt long, ids binary"

    def run(batches):
        tokens = tokens_of(path)
        rank = priorities(tokens.n_ids)
        width = np.dtype("<u2" if tokens.n_ids <= 1 << 16 else "<u4")
        salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for b in common.portions(batches, nbytes=PORTION):
            flat, stop = tokens.encode(b.column("text"))
            n = np.diff(stop, prepend=0)
            many = -(-n // seq)
            doc = np.repeat(np.arange(len(n)), many)
            first = np.cumsum(many) - many
            start = (np.arange(len(doc)) - first[doc]) * seq
            length = np.minimum(seq, n[doc] - start)
            begin = (stop - n)[doc] + start
            full = length == seq
            words = np.ascontiguousarray(flat, "<u4")
            crcs = np.zeros(len(doc), np.int64)
            for k in np.flatnonzero(full):
                crcs[k] = zlib.crc32(words[begin[k] : begin[k] + seq])
            keys, size = np.zeros(len(doc), np.int32), np.where(full, 0, length)
            part = np.repeat((begin - (np.cumsum(size) - size)).astype(np.int32), size) + np.arange(int(size.sum()), dtype=np.int32)
            left = flat[part]
            if len(left):
                keys[~full] = np.minimum.reduceat(rank[left], (np.cumsum(size) - size)[~full])
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64) * width.itemsize
            ids = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(left.astype(width))]).cast(pa.binary())
            cols = [b.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crcs, mask=~full), pa.array(n[doc]), pa.array(keys, mask=full), pa.array(salt + np.arange(len(doc))), ids]
            salt += len(doc)
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def pack(documents: DataFrame, path: str | None = None, seq: int = SEQ, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece; see SCHEMA."""
    path = path or default_path()
    spark = documents.sparkSession
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    made = common.scratch(spark, "pieces")
    with common.small_batches(spark):
        _tokenized(documents, path, seq).write.parquet(made)
    pieces = spark.read.parquet(made)

    def place(batches):
        width = None
        shard, held = -1, []

        def flush():
            rest = sorted(held, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[3]))
            docs = [np.frombuffer(x[3], width) for x in rest]
            rows = [(rest[k][0], rest[k][1] + at, size, crc(docs[k][at : at + size]), rest[k][2], (shard << 32) + number, offset) for k, at, size, number, offset in pack_shard(docs, seq)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        for b in common.portions(batches, "ids"):
            for to, doc_id, start, length, total, ids in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "start", "length", "doc_tokens", "ids"))):
                if to != shard:
                    if held:
                        yield flush()
                    shard = to
                width = width or ("<u2" if len(ids) == 2 * length else "<u4")
                held.append((doc_id, start, total, ids))
        if held:
            yield flush()

    # one row for each token of the vocabulary at most
    tokens = {r["key"]: r["n"] for r in pieces.where("key IS NOT NULL").groupBy("key").agg(F.sum("length").alias("n")).collect()}
    plan = spark.createDataFrame(pa.table(dict(zip(("to_key", "shard", "many"), (pa.array(c, pa.int32()) for c in (zip(*shards_of(tokens, shard_tokens)) if tokens else ([], [], [])))))))
    rest = pieces.where("key IS NOT NULL").join(F.broadcast(plan), F.col("key") == F.col("to_key"))
    shard = (F.col("shard") + F.pmod(F.xxhash64("salt"), F.col("many"))).cast("int")
    laid = rest.select(shard.alias("shard"), "doc_id", "start", "length", "doc_tokens", "ids").repartition("shard").sortWithinPartitions("shard")
    full = pieces.where("key IS NULL").select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(laid.mapInArrow(place, SCHEMA))
