"""Byte-level BPE encoding and decoding by speculation and verification.

Words of a batch are proposed tokens by greedy longest match. A token sequence is what exact
merging yields if and only if every adjacent pair is compatible, that is, if merging the pair's
bytes gives back the pair; one vectorised pass tests all distinct pairs. Words that fail, and only
those, go through exact merging. Encoded words are remembered per worker within a bound.

Defined cases: a null text counts as empty and has no tokens; the special tokens' strings inside a
text become special tokens; texts of any length are encoded whole; repeated rows give repeated
results; an empty table gives an empty result;
columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from graphloom.llm.shared import CUT, cut, text_or_empty, worker_state

#: A worker forgets its encoded chunks beyond so many (they are only a cache).
MEMO_CHUNKS = 700_000
#: The same where digests are made beside the encoding, which take memory of their own.
LEAN_CHUNKS = 300_000
#: Characters of text handled at once; operators take up to some 100 bytes of memory for each.
BATCH_CHARS = 1_000_000
#: Words of more bytes are walked one by one instead of in lockstep.
LOCKSTEP_BYTES = 64

#: Fixed value: the pre-tokenisation pattern of the public vocabulary, for texts without the
#: characters of ODD, where the classes of ``re`` agree with Unicode's letters and numbers.
PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters outside these well-settled ranges send a text through the tokenizers library's own splitter.
ODD = re.compile("[^\n\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏΆ-ϿЀ-ҁҊ-ԯ‐-‧‰-⁞₠-₵ぁ-ゖァ-ヺ一-龥가-힣]")
_FIRST, _WORD = "\x01", "\x02"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of flat[start : start + len] for all pairs."""
    ends = np.cumsum(lens)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1])]


class Vocabulary:
    """Merge table, trie and token bytes of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        model, alphabet = spec["model"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.size = size
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(left * size + right, kind="stable")
        self.keys, self.key_rank = (left * size + right)[order], order
        self.made = made
        self.pair = {int(k): int(r) for k, r in zip(self.keys, self.key_rank, strict=True)}
        # how a token comes about: its rank (-1 for single bytes) and its two halves
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        self.rank[made[::-1]], self.left[made[::-1]], self.right[made[::-1]] = np.arange(len(made))[::-1], left[::-1], right[::-1]
        self.byte_id = np.zeros(256, np.int64)
        for i, b in enumerate(self.bytes):
            if len(b) == 1:
                self.byte_id[b[0]] = i
        own = [i for i in vocab.values()]
        ids, counts = self.merge([self.bytes[i] for i in own])
        alone = counts == 1
        alone[alone] = ids[np.cumsum(counts) - counts][alone] == np.array(own)[alone]
        self._trie([i for i, a in zip(own, alone, strict=True) if a])
        self.flat, self.starts, self.lens = self._table(self.bytes)
        self.dec_flat, self.dec_starts, self.dec_lens = self._table([b"%d," % i for i in range(size)])

    @staticmethod
    def _table(parts: list[bytes]):
        lens = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lens) - lens, lens

    def _trie(self, own: list[int]) -> None:
        """Nodes by (parent, byte); accept has the token that ends at a node. Proposals are only tokens that merging can yield."""
        child: dict[int, int] = {}
        accept = [-1]
        for i in own:
            node = 0
            for b in self.bytes[i]:
                key = node << 8 | b
                node = child.get(key, -1)
                if node < 0:
                    node = child[key] = len(accept)
                    accept.append(-1)
            accept[node] = i
        self.child, self.accept_list = child, accept
        keys = np.array(list(child), np.int64)
        order = np.argsort(keys)
        self.trie_keys, self.trie_nodes = keys[order], np.array(list(child.values()), np.int64)[order]
        self.accept = np.array(accept, np.int64)

    # -- proposals -------------------------------------------------------------------------

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match: flat ids and the number of ids of each word."""
        lens = np.array([len(w) for w in words], np.int64)
        short = np.flatnonzero(lens <= LOCKSTEP_BYTES)
        who, ids = [], []
        if len(short):
            w, t = self._lockstep([words[i] for i in short])
            who.append(short[w])
            ids.append(t)
        for i in np.flatnonzero(lens > LOCKSTEP_BYTES):
            t = self._walk(words[i])
            who.append(np.full(len(t), i))
            ids.append(np.array(t, np.int64))
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, ids = np.concatenate(who), np.concatenate(ids)
        order = np.argsort(who, kind="stable")
        return ids[order], np.bincount(who, minlength=len(words))

    def _walk(self, word: bytes) -> list[int]:
        out, at, child, accept = [], 0, self.child, self.accept_list
        while at < len(word):
            node, p, last, until = 0, at, -1, at
            while p < len(word) and (node := child.get(node << 8 | word[p], -1)) >= 0:
                p += 1
                if accept[node] >= 0:
                    last, until = accept[node], p
            out.append(last)
            at = until
        return out

    def _lockstep(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words advance one byte a turn; (word, token) in the order of each word."""
        lens = np.array([len(w) for w in words], np.int64)
        buf = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        at = np.cumsum(lens) - lens
        end = at + lens
        live = np.flatnonzero(lens > 0)
        at, end = at[live], end[live]
        node, last, until = np.zeros(len(live), np.int64), np.full(len(live), -1), at.copy()
        who, ids = [], []
        n_keys = len(self.trie_keys)
        while len(live):
            key = node << 8 | buf[at]
            pos = np.minimum(np.searchsorted(self.trie_keys, key), n_keys - 1)
            ok = (self.trie_keys[pos] == key) & (at < end)
            node = np.where(ok, self.trie_nodes[pos], 0)
            at = at + ok
            token = np.where(ok, self.accept[node], -1)
            hit = token >= 0
            last = np.where(hit, token, last)
            until = np.where(hit, at, until)
            stop = ~ok
            if stop.any():
                s = np.flatnonzero(stop)
                who.append(live[s])
                ids.append(last[s])
                at[s] = until[s]
                last[s] = -1
                going = ~stop | (at < end)
                if not going.all():
                    live, at, end, node, last, until = live[going], at[going], end[going], node[going], last[going], until[going]
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, ids = np.concatenate(who), np.concatenate(ids)
        order = np.argsort(who, kind="stable")
        return who[order], ids[order]

    # -- verification ----------------------------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging a and b, or a very large number."""
        key = a * self.size + b
        pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[pos] == key, self.key_rank[pos], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b side by side gives a and b.

        Time runs backwards: the half that was formed last is taken apart, and its inner part
        stands at the border before that. A merge across the border spoils the pair if its turn
        came earlier than the forming of what then covered it; of equal turns the left goes first.
        """
        good = np.ones(len(a), bool)
        spoiled = self._ranks(a, b) < 1 << 40
        good[spoiled] = False
        todo = np.flatnonzero(~spoiled)
        x, y = a[todo], b[todo]
        while len(todo):
            rx, ry = self.rank[x], self.rank[y]
            undo_x = rx > ry
            limit = np.where(undo_x, rx, ry + 1)
            nx, ny = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            left = np.maximum(rx, ry) >= 0
            bad = left & (self._ranks(nx, ny) < limit)
            good[todo[bad]] = False
            go = left & ~bad
            todo, x, y = todo[go], nx[go], ny[go]
        return good

    # -- exact merging ---------------------------------------------------------------------

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE: flat ids and the number of ids of each word."""
        lens = np.array([len(w) for w in words], np.int64)
        out: list = [None] * len(words)
        for low, high in ((0, 8), (8, 16), (16, 32), (32, LOCKSTEP_BYTES)):
            some = np.flatnonzero((lens > low) & (lens <= high))
            for k in range(0, len(some), 20_000):
                part = some[k : k + 20_000]
                for i, t in zip(part, self._merge_block([words[i] for i in part], high), strict=True):
                    out[i] = t
        for i in np.flatnonzero(lens > LOCKSTEP_BYTES):
            out[i] = self._merge_heap(words[i])
        for i in np.flatnonzero(lens == 0):
            out[i] = np.zeros(0, np.int64)
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.array([len(t) for t in out], np.int64)

    def _merge_block(self, words: list[bytes], width: int) -> list[np.ndarray]:
        n = len(words)
        lens = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        column = np.arange(width)
        # a spare column of -1 at the right end; its key is never in the table
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = np.where(column < lens[:, None], self.byte_id[raw], -1)
        ranks = self._both(ids[:, :-1], ids[:, 1:])
        rows = np.arange(n)
        result: list = [None] * n
        while len(rows):
            j = ranks.argmin(1)
            r = ranks[np.arange(len(rows)), j]
            done = r >= 1 << 40
            if done.any():
                for k in np.flatnonzero(done):
                    result[rows[k]] = ids[k, : lens[k]].copy()
                go = ~done
                rows, ids, ranks, lens, j, r = rows[go], ids[go], ranks[go], lens[go], j[go], r[go]
                if not len(rows):
                    break
            m = np.arange(len(rows))
            ids[m, j] = self.made[r]
            # what lies right of the merged pair moves one place left
            moved = np.minimum(np.arange(width + 1) + (np.arange(width + 1) > j[:, None]), width)
            ids = np.take_along_axis(ids, moved, 1)
            ids[:, -1] = -1
            lens = lens - 1
            ranks = np.take_along_axis(ranks, np.minimum(moved[:, :-1], width - 1), 1)
            ranks[:, -1] = 1 << 40
            ranks[m, j] = self._both(ids[m, j], ids[m, j + 1])
            before = np.maximum(j - 1, 0)
            ranks[m, before] = self._both(ids[m, before], ids[m, before + 1])
        return result

    def _both(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where((a >= 0) & (b >= 0), self._ranks(a, b), 1 << 40)

    def _merge_heap(self, word: bytes) -> np.ndarray:
        ids = [int(self.byte_id[b]) for b in word]
        before, after = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        size, pair = self.size, self.pair
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (r := pair.get(ids[k] * size + ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            n = after[k]
            if ids[k] != a or n >= len(ids) or ids[n] != b:
                continue
            ids[k], ids[n] = int(self.made[r]), -1
            after[k] = after[n]
            if after[n] < len(ids):
                before[after[n]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q < len(ids) and (r := pair.get(ids[p] * size + ids[q])) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return np.array([i for i in ids if i >= 0], np.int64)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Speculate, verify, repair: flat ids and the number of ids of each word."""
        ids, counts = self.propose(words)
        if len(ids) < 2:
            return ids, counts
        owner = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        keys, back = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        good = self.compatible(keys // self.size, keys % self.size)
        failing = np.unique(owner[inner[~good[back]]])
        if not len(failing):
            return ids, counts
        fixed, fixed_counts = self.merge([words[i] for i in failing])
        starts = np.cumsum(counts) - counts
        source = np.concatenate([ids, fixed])
        starts[failing] = len(ids) + np.cumsum(fixed_counts) - fixed_counts
        counts = counts.copy()
        counts[failing] = fixed_counts
        return ragged(source, starts, counts), counts


class Codec:
    """Encodes and decodes texts; remembers the ids of chunks of text between blanks."""

    def __init__(self, path: str, memo_chunks: int | None = None):
        self.vocabulary, self.memo_chunks = Vocabulary(path), memo_chunks or MEMO_CHUNKS
        self.any_special = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")") if self.vocabulary.special else None
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lens = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _split(self, text: str) -> list[str]:
        """Chunks whose ids add up to the text's. A blank between two characters that are not white space always starts a word, so cutting there changes nothing."""
        if self.any_special and any(s in text for s in self.vocabulary.special):
            out = []
            for part in self.any_special.split(text):
                out += [_WORD + part] if part in self.vocabulary.special else self._split(part) if part else []
            return out
        if ODD.search(text):
            return [_WORD + w for w in self._library_words(text)]
        chunks = text.replace("\n", " \n").split(" ")
        if "" in chunks or "\n" in chunks:
            return [_WORD + w for w in PATTERN.findall(text)]
        if chunks[0][0] != "\n":
            chunks[0] = _FIRST + chunks[0]
        return chunks

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary.path)

    def _library_words(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def _learn(self, chunks: list[str]) -> None:
        words: dict[str, int] = {}
        spelled, counts = [], []
        for c in chunks:
            mark = c[0]
            if mark == _WORD:
                parts = [c[1:]]
            elif mark == _FIRST:
                parts = PATTERN.findall(c[1:])
            else:
                parts = PATTERN.findall(c if mark == "\n" else " " + c)
            counts.append(len(parts))
            spelled += [words.setdefault(w, len(words)) for w in parts]
        special = self.vocabulary.special
        ids, sizes = self.vocabulary.encode_words([b"" if w in special else w.encode() for w in words])
        starts = np.cumsum(sizes) - sizes
        for w in special.keys() & words.keys():
            starts[words[w]], sizes[words[w]] = len(ids), 1
            ids = np.append(ids, special[w])
        spelled = np.array(spelled, np.int64)
        flat = ragged(ids, starts[spelled], sizes[spelled])
        total = np.cumsum(sizes[spelled])
        ends = np.concatenate([[0], total])[np.cumsum(counts)]
        begin = np.concatenate([[0], ends[:-1]])
        known = len(self.memo)
        while known + len(chunks) > len(self.starts):
            self.starts, self.lens = np.concatenate([self.starts, self.starts]), np.concatenate([self.lens, self.lens])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[known : known + len(chunks)] = self.used + begin
        self.lens[known : known + len(chunks)] = ends - begin
        self.used += len(flat)
        self.memo.update(zip(chunks, range(known, known + len(chunks)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (int32) and the number of ids of each text. A very long text is encoded part by part."""
        if max(map(len, texts), default=0) <= CUT:
            return self._encode(texts)
        parts = [self._encode([part]) for t in texts for part in cut(t)]
        owner = [i for i, t in enumerate(texts) for _ in cut(t)]
        return np.concatenate([ids for ids, _ in parts]), np.bincount(owner, [int(n[0]) for _, n in parts], len(texts)).astype(np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > self.memo_chunks:
            self._forget()
        split = [self._split(t) if t else [] for t in texts]
        memo = self.memo
        new = {c for chunks in split for c in chunks if c not in memo}
        if new:
            self._learn(sorted(new))
        sizes = np.array([len(c) for c in split], np.int64)
        index = np.fromiter((memo[c] for chunks in split for c in chunks), np.int64, int(sizes.sum()))
        lens = self.lens[index]
        flat = ragged(self.flat, self.starts[index], lens)
        total = np.concatenate([[0], np.cumsum(lens)])
        ends = total[np.cumsum(sizes)] if len(sizes) else total[:0]
        return flat, np.diff(np.concatenate([[0], ends]))

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids in a row, and the number of bytes of each id."""
        v = self.vocabulary
        lens = v.lens[ids]
        return ragged(v.flat, v.starts[ids], lens), lens

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """One text for each run of ids; broken UTF-8 becomes replacement characters."""
        data, lens = self.decode_bytes(ids)
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]
        data = data.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decimal(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """The ids of each text in decimal, joined by commas."""
        v = self.vocabulary
        lens = v.dec_lens[ids]
        data = memoryview(ragged(v.dec_flat, v.dec_starts[ids], lens).tobytes())
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]
        return [data[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def codec(path: str, memo_chunks: int | None = None) -> Codec:
    """The worker's codec, kept between tasks."""
    return worker_state(("bpe", path, memo_chunks), lambda: Codec(path, memo_chunks))


def pieces(batch: pa.RecordBatch, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some BATCH_CHARS of text each."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += n + 8
        if total >= BATCH_CHARS:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _map(docs: DataFrame, path: str, schema: str, make) -> DataFrame:
    def run(batches):
        own = codec(path, LEAN_CHUNKS)
        for batch in batches:
            for piece in pieces(batch):
                yield make(own, piece)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def make(own, piece):
        flat, counts = own.encode(piece.column(1).to_pylist())
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.record_batch([piece.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    return _map(docs, path, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>", make)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row's ids (null: empty)."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = [np.asarray(x or [], np.int64) for x in part.column(1).to_pylist()]
                texts = own.decode(np.concatenate(lists), np.array([len(x) for x in lists], np.int64))
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: ids and decoded text stay in the worker, only digests leave it."""

    def make(own, piece):
        flat, counts = own.encode(piece.column(1).to_pylist())
        return pa.record_batch(
            [
                piece.column(0),
                pa.array(counts, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in own.decimal(flat, counts)], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in own.decode(flat, counts)], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _map(docs, path, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
