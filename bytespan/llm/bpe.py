r"""BPE encoding and decoding by batched numpy merge rounds.

A batch of texts is cut at white space in one flat array of bytes, and each piece
is looked up by a 64-bit hash in a table of the pieces met before. Each distinct
new piece is pre-tokenised into words, and the distinct words' symbols lie one
after another in one flat array. In each round every word's adjacent pairs are
looked up by binary search in the sorted keys of all merges; the lowest rank of
each word is merged at all its places, words without a mergeable pair leave, and
the rest go on. So the Python interpreter works per distinct new piece alone.

The vocabulary file is that of the public tokenizers library (model BPE with a
byte-level alphabet, an end-of-word suffix, NFC and lower case as normalisers,
added tokens cut out of the raw text first). Its path is a parameter; the
driver reads it once and its text (about 2 MB, a fixed size) is broadcast.

The table of pieces holds at most REMEMBERED of them and REMEMBERED_IDS ids, then
starts anew; pieces of more than LONG bytes (text without spaces) are never kept.
Two pieces with one 64-bit hash would be taken for each other: for a full table
the chance is 1e-13 a new piece.

Defined cases: a null or empty text has no tokens; texts of any length are
encoded whole, in parts cut at spaces; repeated rows are encoded alike; other
columns pass through.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from bytespan.llm.common import ship
from bytespan.llm.words import SPACE as SPACES
from bytespan.llm.words import Words, buffers

#: Pieces and ids that a worker remembers, about 100 MB, and bytes beyond which a piece isn't kept.
REMEMBERED, REMEMBERED_IDS, LONG = 2_000_000, 8_000_000, 256
#: Bytes of text that are encoded at once.
PART = 2_000_000
#: Marks that never belong to a word beside letters.
PLAIN_ENDS = frozenset(",.!?;:")
#: Control characters that Python's split takes for white space but regular expressions don't.
ODD_SPACES = "\x1c\x1d\x1e\x1f"
SPACE = regex.compile(r"\p{White_Space}+")
#: White space beyond ASCII, as UTF-8, and the first bytes of it (fixed values of Unicode).
WIDE_SPACES = frozenset("\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
WIDE_LEAD = np.zeros(256, bool)
WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next code point from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else free))
        free += b not in shown
    return out


class Pieces:
    """An open hash table in flat arrays: 64-bit keys of pieces, and where the ids of each lie."""

    def __init__(self):
        self.bits, self.count, self.used = 16, 0, 0
        self.key, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.begin, self.size = np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32)
        self.flat = np.zeros(1 << 17, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each key; -1 for unknown ones. Keys are not 0."""
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        seen = self.key[slot]
        hit = seen == h
        out = np.where(hit, self.place[slot], -1)
        going = np.flatnonzero(~hit & (seen != 0))
        slot = slot[going]
        while len(going):
            slot = (slot + 1) & mask
            seen = self.key[slot]
            hit = seen == h[going]
            out[going[hit]] = self.place[slot[hit]]
            stay = ~hit & (seen != 0)
            going, slot = going[stay], slot[stay]
        return out

    def _put(self, h: np.ndarray, entry: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.key[slot] == 0
            self.key[slot[free]] = h[free]  # of several for one slot the last stays
            won = self.key[slot] == h
            self.place[slot[won]] = entry[won]
            h, entry, slot = h[~won], entry[~won], (slot[~won] + 1) & mask

    def add(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """New distinct keys with their ids, one key's after another's."""
        if self.count + len(h) > REMEMBERED or self.used + len(ids) > REMEMBERED_IDS:
            self.__init__()
            if len(h) > REMEMBERED or len(ids) > REMEMBERED_IDS:
                return
        while 2 * (self.count + len(h)) > 1 << self.bits:
            old = np.flatnonzero(self.key)
            h_old, entry_old = self.key[old], self.place[old]
            self.bits += 1
            self.key, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(h_old, entry_old)
        for name, need in (("begin", self.count + len(h)), ("size", self.count + len(h)), ("flat", self.used + len(ids))):
            now = getattr(self, name)
            if need > len(now):
                setattr(self, name, np.r_[now, np.zeros(max(need, 2 * len(now)) - len(now), now.dtype)])
        entry = np.arange(self.count, self.count + len(h))
        self.begin[entry], self.size[entry] = self.used + np.cumsum(size) - size, size
        self.flat[self.used : self.used + len(ids)] = ids
        self._put(h, entry.astype(np.int32))
        self.count, self.used = self.count + len(h), self.used + len(ids)


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of every run, one run after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class Table:
    """Byte strings by number, in flat arrays."""

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.begin, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(texts), np.uint8)

    def joined(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """The strings of ids, joined; ids[begin[t] : begin[t + 1]] belong to result t."""
        size = self.size[ids]
        raw, upto = self.data[runs(self.begin[ids], size)].tobytes(), np.r_[0, np.cumsum(size)]
        return [raw[a:b] for a, b in zip(upto[begin[:-1]].tolist(), upto[begin[1:]].tolist(), strict=True)]


class Vocabulary:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        suffix = model["end_of_word_suffix"] or ""
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.cut_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        alphabet = byte_alphabet()
        self.inner = np.array([self.ids[c] for c in alphabet], np.int64)
        self.final = np.array([self.ids[c + suffix] for c in alphabet], np.int64)
        self.size = max(self.tokens) + 1
        left = np.array([self.ids[a] for a, _ in model["merges"]], np.int64)
        right = np.array([self.ids[b] for _, b in model["merges"]], np.int64)
        keys, order = left * self.size + right, np.arange(len(left), dtype=np.int64)
        made = np.array([self.ids[a + b] for a, b in model["merges"]], np.int64)
        by_key = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[by_key], order[by_key], np.append(made, -1)
        self.none = len(order)  # the rank of pairs that don't merge
        self.keys, self.ranks = np.append(self.keys, np.iinfo(np.int64).max), np.append(self.ranks, self.none)
        self.memory = Pieces()
        every = [self.tokens.get(i, "") for i in range(self.size)]
        #: Each id, and each token, with a space after it.
        self.id_texts, self.token_texts = Table([b"%d " % i for i in range(self.size)]), Table([f"{t} ".encode("utf-8", "surrogatepass") for t in every])

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, by binary search over the sorted pair keys."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, where each word's begin and the last ends), for non-empty words."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), lengths)
        done_symbols, done_owner = [], []
        # rank[i] is that of the pair (i, i + 1); none at the end of a word
        rank = np.full(len(symbols), self.none)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        rank[same] = self.pair_ranks(symbols[same], symbols[same + 1])
        while len(symbols):
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, begin)
            size = np.diff(np.r_[begin, len(symbols)])
            going = np.repeat(least < self.none, size)
            if not going.all():
                done_symbols.append(symbols[~going])
                done_owner.append(owner[~going])
                symbols, owner, rank = symbols[going], owner[going], rank[going]
                if not len(symbols):
                    break
                least, size = least[least < self.none], size[least < self.none]
            target = np.repeat(least, size)
            hit = rank == target
            # of overlapping hits (a run of one symbol) every second one from its first counts
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():
                first = np.r_[True, np.diff(at) != 1]
                run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[target[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            now = place[at]
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            # only pairs next to a merge have changed
            touched = np.zeros(len(symbols), bool)
            touched[now] = touched[np.maximum(now - 1, 0)] = True
            stale = np.flatnonzero(touched)
            last = np.r_[owner[1:] != owner[:-1], True][stale]
            rank[stale[last]] = self.none
            live = stale[~last]
            rank[live] = self.pair_ranks(symbols[live], symbols[live + 1])
        flat, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.searchsorted(owner[order], np.arange(len(raw) + 1))

    def normalised(self, piece: str) -> str:
        """NFC, then each character's own lower case (a final sigma has no form of its own here)."""
        if piece.isascii():
            return piece.lower()
        piece = unicodedata.normalize("NFC", piece)
        return "".join(c.lower() for c in piece) if "Σ" in piece else piece.lower()

    def pieces(self, text: str) -> list[str]:
        """White-space separated pieces of text; an added token is a piece of its own that begins with NUL, NUL."""
        if self.cut_added and "<|" in text and (found := self.cut_added.findall(text)):
            rest = self.cut_added.split(text)
            out = self.pieces(rest[0])
            for token, part in zip(found, rest[1:], strict=True):
                out += ["\0\0" + token, *self.pieces(part)]
            return out
        if any(c in text for c in ODD_SPACES):
            return [p for p in SPACE.split(text) if p]
        return text.split()

    def learned(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, how many each has)."""
        words: dict[str, int] = {}
        add, of, count = words.setdefault, [], []  # the words of all pieces, and how many each has
        special = {"\0\0" + t: i for t, i in self.added.items()}
        for p in pieces:
            low = p.lower() if p.isascii() else self.normalised(p)
            if low.isalpha():  # one run of letters
                of.append(add(low, len(words)))
                count.append(1)
            elif low[-1] in PLAIN_ENDS and low[:-1].isalpha():  # letters and one mark, as most other pieces
                of += add(low[:-1], len(words)), add(low[-1], len(words))
                count.append(2)
            elif p in special:
                of.append(-1 - special[p])
                count.append(1)
            else:
                found = self.words.findall(low)
                of += [add(w, len(words)) for w in found]
                count.append(len(found))
        ids, at = self.merge_words(list(words)) if words else (np.empty(0, np.int64), np.zeros(1, np.int64))
        word = np.array(of, np.int64)
        known = word >= 0
        # an added token is a word of one id, beyond the others
        ids, begin = np.r_[ids, -1 - word[~known]], np.zeros(len(word), np.int64)
        size = np.ones(len(word), np.int64)
        begin[known], size[known] = at[word[known]], at[word[known] + 1] - at[word[known]]
        begin[~known] = at[-1] + np.arange((~known).sum())
        total = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(count)]]
        return ids[runs(begin, size)].astype(np.uint32), np.diff(total)

    def plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts whose pieces stand between ASCII spaces: those with other white space or added tokens are rewritten."""
        odd = np.zeros(len(raw), bool)
        for at in np.flatnonzero(WIDE_LEAD[raw]):
            odd[at] = raw[at : at + 3].tobytes().decode("utf-8", "ignore")[:1] in WIDE_SPACES
        if self.added and len(raw) > 1:
            odd[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        if not odd.any():
            return raw, offsets
        parts = []
        for t in np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1):
            text = raw[offsets[t] : offsets[t + 1]].tobytes().decode("utf-8", "surrogatepass")
            parts.append((t, " ".join(self.pieces(text)).encode("utf-8", "surrogatepass")))
        sizes, out, at = np.diff(offsets), [], 0
        for t, new in parts:
            out += [raw[at : offsets[t]].tobytes(), new]
            at, sizes[t] = offsets[t + 1], len(new)
        return np.frombuffer(b"".join([*out, raw[at:].tobytes()]), np.uint8), np.r_[0, np.cumsum(sizes)]

    def part_ids(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of some texts, where each text's begin and the last ends)."""
        raw, offsets = self.plain(raw, offsets)
        words = Words(raw, offsets, lower=False)
        h = np.maximum(words.hashes, np.uint64(1))
        entry = self.memory.find(h)
        new = np.flatnonzero(entry < 0)
        begin, size, flat = self.memory.begin[entry].astype(np.int64), self.memory.size[entry].astype(np.int64), self.memory.flat[: self.memory.used]
        if len(new):
            key, first, which = np.unique(h[new], return_index=True, return_inverse=True)
            starts = words.starts[new[first]]
            ends = np.append(words.starts, len(raw))[new[first] + 1]
            data = raw.tobytes()
            pieces = [data[a:b].rstrip(b" \t\n\x0b\x0c\r").decode("utf-8", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            collecting = gc.isenabled()
            gc.disable()  # the many short strings hold no cycles
            try:
                ids, count = self.learned(pieces)
            finally:
                if collecting:
                    gc.enable()
            own = np.cumsum(count) - count
            # ids of new pieces stand behind those that were known
            begin[new], size[new] = len(flat) + own[which], count[which]
            flat = np.r_[flat, ids]
            short = np.array([len(p) <= LONG for p in pieces], bool)
            self.memory.add(key[short], ids[runs(own[short], count[short])], count[short])
        return flat[runs(begin, size)], np.r_[0, np.cumsum(size)][words.begin]

    def ids_of(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, text after the last, ids, where each text's begin): texts in order, some at a time, each whole.

        raw: the texts' bytes, one after another; offsets: where each begins, and the end. A text of more than PART
        bytes is encoded in parts that end where a space stands."""
        t, n = 0, len(offsets) - 1
        while t < n:
            end = min(max(int(np.searchsorted(offsets, offsets[t] + PART, "right")) - 1, t + 1), n)
            if end == t + 1 and offsets[end] - offsets[t] > PART:
                own, at, ids = raw[offsets[t] : offsets[end]], 0, []
                marked = b"<|" in own.tobytes()  # added tokens may hold spaces: such a text isn't cut
                while at < len(own):
                    upto = len(own)
                    if not marked and upto - at > PART:
                        spaces = np.flatnonzero(SPACES[own[at + PART :][:PART]])
                        while not len(spaces) and (upto := at + 2 * PART) < len(own):  # a piece of more than PART bytes
                            spaces = np.flatnonzero(SPACES[own[upto:]])
                            break
                        upto = at + PART + int(spaces[0]) if len(spaces) and upto == len(own) else upto + int(spaces[0]) if len(spaces) else len(own)
                    ids.append(self.part_ids(own[at:upto], np.array([0, upto - at]))[0])
                    at = upto
                whole = np.concatenate(ids)
                yield t, end, whole, np.array([0, len(whole)])
            else:
                yield t, end, *self.part_ids(raw[offsets[t] : offsets[end]], offsets[t : end + 1] - offsets[t])
            t = end

    def encode(self, text: str | None) -> list[int]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        return [i for *_, ids, _ in self.ids_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) for i in ids.tolist()]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by one space; unknown ids are passed over."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(text: str) -> Vocabulary:
    """The worker's vocabulary of a file's text, built once; only the last one stays."""
    name = hashlib.sha256(text.encode()).hexdigest()
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Vocabulary(text)
    return _loaded[name]


def broadcast_file(spark: SparkSession, path: str):
    """The vocabulary file's text, for all executors. Its size is that of the file, whatever the data."""
    ship(spark)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str, text: str, key: str, made: dict[str, str]) -> DataFrame:
    """(key, n_tokens, then as made says: ids and decoded as text, or their digests) of every row."""
    shared = broadcast_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        finish = {"text": lambda b: b.decode("utf-8", "surrogatepass"), "sha256": lambda b: hashlib.sha256(b).hexdigest()}
        for batch in batches:
            for a, b, ids, begin in vocab.ids_of(*buffers(batch.column(1))):
                out = {"key": batch.column(0).slice(a, b - a), "n_tokens": pa.array(np.diff(begin), pa.int64())}
                for name, kind in made.items():
                    table = vocab.id_texts if name.startswith("ids") else vocab.token_texts
                    # the last id or token has no space after it
                    out[name] = pa.array([finish[kind](x[:-1]) for x in table.joined(ids, begin)], pa.string())
                yield pa.record_batch(out)

    kind = dict(docs.dtypes)[key]
    rows = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, f"key {kind}, n_tokens long, " + ", ".join(f"{c} string" for c in made))
    return rows.withColumnRenamed("key", key)


def encode_column(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids as text joined by one space, decoded) of every row."""
    return encoded(docs, path, text, key, {"ids": "text", "decoded": "text"})


def digest_column(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode, decode, and hash where the rows are, so that no ids travel."""
    return encoded(docs, path, text, key, {"ids_sha256": "sha256", "decoded_sha256": "sha256"})
