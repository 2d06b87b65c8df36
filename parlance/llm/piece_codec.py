"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where a word starts: no piece of the vocabulary goes on behind a
run of word marks that follows another character, so words merge by themselves.
The distinct new words of a batch become one flat array of symbols. A round
looks up the rank of every adjacent pair, takes each word's smallest rank by a
segmented minimum, merges the leftmost occurrence of that pair in all words at
once, and compacts the array; a word without a pair leaves it. Where no later
piece can outrank the merged one (known from the vocabulary), all of its
occurrences that don't overlap merge in the same round, from the left. A long
word of pieces that later ones can outrank (`SLOW_ROUNDS` rounds with hardly a
merge) is ended by a queue of its pairs, in the same order of merges.
Characters without a piece become their bytes' pieces.

Word results are kept in a dictionary of bounded size (`CACHE_WORDS`), which is
emptied when full; it saves time and changes no result.

Edge cases: a null or empty text has only the end id and decodes to the empty
string; texts and words of any length are merged whole; a repeated row gets its
copy's result; an empty table gives an empty table; other columns are neither
read nor returned.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm.common import prepare

MARK = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CACHE_WORDS = 300_000
#: Rows encoded at a time, for bounded memory.
STEP_ROWS = 256
#: Symbols that are merged at a time; a longer word is taken alone.
STEP_CHARS = 200_000
NO_RANK = np.int64(1 << 40)
#: Rounds after which long words that still have many pairs left are ended one by one, and what is long.
SLOW_ROUNDS, LONG_WORD = 400, 1000


class PieceModel:
    """The vocabulary as arrays: piece bytes, merge table and byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.unk, self.bos, self.eos = sp.unk_id(), sp.bos_id(), sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(pieces[i][1:-1], 16)] = i
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        ids = {pieces[i]: i for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in ids):
            raise ValueError("a piece goes on behind a word's start; words can't be merged by themselves")
        #: best score first; ties keep the smaller id
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        #: of a code point, its piece's id; else minus 1 and the code point
        self.char_id = -1 - np.arange(0x110000)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        pairs = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        left, right, whole = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        key = left * n + right
        by = np.argsort(key)
        self.n, self.key, self.whole = n, key[by], whole[by]
        self.rank = np.full(n, NO_RANK)
        self.rank[list(rank)] = list(rank.values())
        #: pieces that may form a piece of a better rank with a neighbour: only their leftmost occurrence merges in a round
        self.overtaken = np.zeros(n, bool)
        for a in (left, right):
            self.overtaken[a[self.rank[whole] < self.rank[a]]] = True
        #: for the queue: of a pair, the rank and the piece
        self.merges: dict[int, tuple[int, int]] = {}
        self.bytes = [b"" if sp.is_control(i) else bytes([int(p[1:-1], 16)]) if self.is_byte[i] else " ⁇ ".encode() if i == self.unk else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.text = [str(i) for i in range(n)]

    def paired(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that the symbol at each place forms with the next one of its word, and its rank; -1 and NO_RANK for none."""
        whole = np.full(len(at), -1, np.int64)
        inner = np.flatnonzero(at < len(sym) - 1)
        left = at[inner]
        inner = inner[(word[left] == word[left + 1]) & (sym[left] >= 0) & (sym[left + 1] >= 0)]
        left = at[inner]
        k = sym[left] * self.n + sym[left + 1]
        found = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        whole[inner] = np.where(self.key[found] == k, self.whole[found], -1)
        return whole, np.where(whole >= 0, self.rank[whole], NO_RANK)

    def by_queue(self, sym: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """What the merges leave of one word's symbols, with their first places: the smallest rank first, the leftmost of equal ones."""
        if not self.merges:
            self.merges.update(zip(self.key.tolist(), zip(self.rank[self.whole].tolist(), self.whole.tolist(), strict=True), strict=True))
        merges, n, size = self.merges, self.n, len(sym)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < size and sym[i] >= 0 and sym[j] >= 0 and (m := merges.get(sym[i] * n + sym[j])):
                heapq.heappush(queue, (m[0], i, sym[i], sym[j]))

        for i in range(size - 1):
            offer(i, i + 1)
        gone = np.zeros(size, bool)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if gone[i] or j >= size or sym[i] != left or sym[j] != right:
                continue
            sym[i] = merges[left * n + right][1]
            gone[j] = True
            after[i] = after[j]
            if after[j] < size:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        at = np.flatnonzero(~gone)
        return at, np.array(sym, np.int64)[at]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, its spaces already marks."""
        sym = self.char_id[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        # what can't merge with a neighbour keeps its place; a negative symbol is a character without a piece
        place = np.arange(len(sym))
        whole, rank = self.paired(sym, word, np.arange(len(sym)))
        rounds = 0
        while len(sym):
            rounds += 1
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(sym)))
            best = np.minimum.reduceat(rank, first)
            keep = best < NO_RANK
            if not keep.all():  # compaction: words without a pair are done
                live = np.repeat(keep, size)
                done.append((place[~live], sym[~live]))
                sym, word, place, rank, whole = sym[live], word[live], place[live], rank[live], whole[live]
                best, size = best[keep], size[keep]
                first = np.cumsum(size) - size
            if not len(sym):
                break
            if rounds % SLOW_ROUNDS == 0 and (size >= LONG_WORD).any():
                for a, n in zip(first[size >= LONG_WORD].tolist(), size[size >= LONG_WORD].tolist(), strict=True):
                    at, left = self.by_queue(sym[a : a + n].tolist())
                    done.append((place[a : a + n][at], left))
                live = np.repeat(size < LONG_WORD, size)
                sym, word, place, rank, whole = sym[live], word[live], place[live], rank[live], whole[live]
                continue
            hit = np.flatnonzero(rank == np.repeat(best, size))
            segment = np.searchsorted(first, hit, "right") - 1
            leftmost = np.concatenate([[True], segment[1:] != segment[:-1]])
            # of neighbouring occurrences, every second one from the left of their run
            opens = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            run = np.flatnonzero(opens)
            odd = (np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 1
            hit = hit[leftmost | ~(odd | self.overtaken[whole[hit]])]
            sym[hit] = whole[hit]
            stays = np.ones(len(sym), bool)
            stays[hit + 1] = False
            sym, word, place, rank, whole = sym[stays], word[stays], place[stays], rank[stays], whole[stays]
            # only the pairs beside a merged symbol are new
            at = hit - np.arange(len(hit))
            near = np.concatenate([at, at[at > 0] - 1])
            whole[near], rank[near] = self.paired(sym, word, near)
        if not done:
            return [[] for _ in words]
        place, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(place)
        place, sym = place[by], sym[by]
        ends = np.cumsum([len(w) for w in words])
        cuts = np.searchsorted(place, np.concatenate([[0], ends]))
        out = []
        bare = (sym < 0).any()
        flat = sym.tolist()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            ids = flat[a:b]
            if bare and min(ids) < 0:
                ids = [j for i in ids for j in ([i] if i >= 0 else self.byte_id[list(chr(-1 - i).encode("utf-8", "replace"))].tolist())]
            out.append(ids)
        return out


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceCodec:
    """Encodes and decodes texts; `model` is the vocabulary's path."""

    def __init__(self, model: str):
        self.model = PieceModel(model)
        #: of each known word: its ids, these in decimal, and its pieces' bytes
        self.ids: dict[str, list[int]] = {}
        self.decimal: dict[str, str] = {}
        self.data: dict[str, bytes] = {}

    def words(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text; all of them are known until the next call."""
        if len(self.ids) > CACHE_WORDS:
            for d in (self.ids, self.decimal, self.data):
                d.clear()
        split = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = [w for w in {w for ws in split for w in ws} if w not in self.ids]
        text, table = self.model.text, self.model.bytes
        at = 0
        while at < len(new):  # bounded symbols at a time
            to, chars = at, 0
            while to < len(new) and (to == at or chars + len(new[to]) <= STEP_CHARS):
                chars += len(new[to])
                to += 1
            for w, ids in zip(new[at:to], self.model.encode_words(new[at:to]), strict=True):
                self.ids[w] = ids
                self.decimal[w] = " ".join([text[i] for i in ids])
                self.data[w] = b"".join([table[i] for i in ids])
            at = to
        return split

    def encode_batch(self, texts: list[str | None], eos: bool = True) -> list[list[int]]:
        return [[i for w in ws for i in self.ids[w]] + [self.model.eos] * eos for ws in self.words(texts)]

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of ids with the end id, their decimals joined by one space, the decoded text) of each text."""
        for ws in self.words(texts):
            decimal = " ".join([*map(self.decimal.__getitem__, ws), self.model.text[self.model.eos]])
            data = b"".join(map(self.data.__getitem__, ws))
            yield decimal.count(" ") + 1, decimal, self.stripped(data, self.ids[ws[0]][0] if ws else None)

    def stripped(self, data: bytes, lead: int | None) -> str:
        """Decoded bytes without the space that encoding put before the text; `lead` is the first id."""
        if lead is not None and not self.model.is_byte[lead] and data[:1] == b" ":
            data = data[1:]
        return data.decode(errors="replace")

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, marks as spaces, the first space that encoding put before the text left out."""
        m = self.model
        return self.stripped(b"".join([m.bytes[i] for i in ids]), next((i for i in ids if i not in (m.bos, m.eos)), None))


_CODECS: dict[str, PieceCodec] = {}


def codec(model: str) -> PieceCodec:
    if model not in _CODECS:
        _CODECS[model] = PieceCodec(model)
    return _CODECS[model]


def digest(df: DataFrame, model: str) -> DataFrame:
    """The contract's row for each `doc_id, text`; `model` is a path that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            sizes, ids_sha, decoded_sha = [], [], []
            for i in range(0, len(batch), STEP_ROWS):
                for n, decimal, decoded in c.digests(batch["text"][i : i + STEP_ROWS].to_pylist()):
                    sizes.append(n)
                    ids_sha.append(hashlib.sha256(decimal.encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    prepare(df.sparkSession)
    return df.select("doc_id", "text").mapInArrow(run, SCHEMA)
