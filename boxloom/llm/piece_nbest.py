"""SentencePiece encoding and decoding with n-best segmentation.

A text becomes a lattice of vocabulary pieces. A forward Viterbi pass gives the best score from the start to every
position; a backward A* search from the end uses these scores as exact heuristics, so complete segmentations come off
the agenda in the order of their scores, best first.

A lattice falls apart wherever no piece of the vocabulary holds two neighbouring characters, as between a letter and
the space after it. The n best of the whole text are then exactly the n best sums over the parts: only the n - 1 parts
with the least loss from best to second best can differ from their best in any of them. Parts are searched once and
cached, which keeps very long texts linear. A part itself, such as a long run of one character, takes n times its
edges at most.

The forward pass runs on arrays: the distinct words of a batch of texts, end to end, walk the trie of pieces together, one
character a step, and the edges found are relaxed for all words at once, by start and length. Words over ``LONG``
characters are cut into parts and take the same steps one by one.

Scores are the model's own piece scores, added up (for a BPE model: minus the merge ranks). A character that is no
piece is encoded as its UTF-8 bytes at ``unknown_penalty`` below the least score of a piece with
any other character than the meta symbol. Spaces become the meta symbol, one of
which is put before the text; there is no other normalisation. A meta symbol of the text itself (U+2581) is no space: it
is encoded as bytes, so that every text is restored. Equal scores: the order of the search, which depends on
the part and the model alone. What a part's second best loses is read off its forward and backward scores, so the A*
search runs only where a document's n best may differ from its best.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

SPACE = "▁"
#: Stands for a meta symbol that the text itself holds; no text can hold a lone surrogate.
OWN_SPACE = "\udc81"
#: Words of more characters are searched one by one.
LONG = 48
#: Longer parts are not kept for the next text.
KEPT = 1000
Segmentation = tuple[float, bytes]  # score, ids as little-endian unsigned 32-bit numbers
Edge = tuple[int, int, float, bytes]  # start, end, score, ids
Part = tuple[float, bytes, float]  # best score, its ids, loss of the second best


class PieceModel:
    """The pieces, scores and byte ids of a model file, and a bounded cache of searched parts."""

    def __init__(self, path: str | None = None, pieces: dict[str, tuple[int, float]] | None = None, byte_ids: list[int] | None = None, n: int = 3, unknown_penalty: float = 10.0, most: int = 400_000):
        if path is not None:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            size = sp.get_piece_size()
            byte_ids = [i for i in range(size) if sp.is_byte(i)]
            pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.pieces, self.byte_ids, self.n, self.most = pieces, byte_ids, n, most
        self.unknown = min((s for p, (_, s) in pieces.items() if p.strip(SPACE)), default=0.0) - unknown_penalty
        # a piece's score and id, or None for what only begins a piece
        self.table: dict[str, tuple[float, bytes] | None] = {p[:k]: None for p in pieces for k in range(1, len(p))}
        self.table |= {p: (s, k.to_bytes(4, "little")) for p, (k, s) in pieces.items()}
        self.pairs = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.joined = any(p[1] == SPACE and p[0] != SPACE for p in self.pairs)
        self.raw = {i: p.replace(SPACE, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.parts: dict[str, Part] = {}
        self.chunks: dict[str, Part] = {}
        self.several: dict[str, list[Segmentation]] = {}
        # the trie as sorted keys (node, character), each with its child; a node's score and id, or -1
        node = {"": 0} | {t: k for k, t in enumerate(self.table, 1)}
        keys = np.array([node[t[:-1]] << 21 | ord(t[-1]) for t in self.table], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], (order + 1).astype(np.int64)
        own = [(0.0, -1), *[(0.0, -1) if x is None else (x[0], int.from_bytes(x[1], "little")) for x in self.table.values()]]
        self.node_score, self.node_id = np.array([x[0] for x in own]), np.array([x[1] for x in own], dtype=np.int64)

    def edges(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """All edges of the chunks, which lie end to end with one position more than characters each: start and end
        position, score and id (-1 less the code of a character that is no piece), by place of the start in its chunk, then
        by length; the bounds of these groups; and the chunks' first positions."""
        sizes = np.array([len(c) for c in chunks], dtype=np.int64)
        of = np.repeat(np.arange(len(chunks)), sizes)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        left = np.cumsum(sizes)[of] - np.arange(len(codes))  # characters from here to the end
        at, node, found = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), []
        for length in range(1, LONG + 1):
            key = node << 21 | codes[at + length - 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[place] == key
            node = self.child[place]
            piece = there & (self.node_id[node] >= 0)
            if length == 1:
                odd = np.flatnonzero(~piece)
                found.append((odd, np.ones(len(odd), dtype=np.int64), np.full(len(odd), self.unknown), -1 - codes[odd]))
            own = node[piece]
            found.append((at[piece], np.full(len(own), length), self.node_score[own], self.node_id[own]))
            go = there & (left[at] > length)
            at, node = at[go], node[go]
            if not len(at):
                break
        at, length, score, ids = (np.concatenate(x) for x in zip(*found))
        start = at + of[at]
        group = (start - first[of[at]]) * (LONG + 1) + length
        order = np.argsort(group.astype(np.uint16), kind="stable")
        start, length, group = start[order], length[order], group[order]
        bounds = np.concatenate((np.flatnonzero(np.diff(group, prepend=-1)), [len(group)]))
        return start, start + length, score[order], ids[order], bounds, first

    def learn(self, chunks: list[str]) -> None:
        """Viterbi over many chunks at once: each one's best segmentation and what its second best loses."""
        some = [c for c in chunks if len(c) <= LONG]
        if not some:
            return
        start, end, score, ids, bounds, first = self.edges(some)
        last = first + np.array([len(c) for c in some])
        size = int(last[-1]) + 1
        best, rest = np.full(size, -np.inf), np.full(size, -np.inf)
        best[first], rest[last] = 0.0, 0.0
        back, back_id = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        for a, b in cuts:  # edges of one group end at different positions
            e = end[a:b]
            reach = best[start[a:b]] + score[a:b]
            better = np.flatnonzero(reach > best[e])
            e = e[better]
            best[e], back[e], back_id[e] = reach[better], start[a:b][better], ids[a:b][better]
        for a, b in reversed(cuts):
            s = start[a:b]
            rest[s] = np.maximum(rest[s], score[a:b] + rest[end[a:b]])
        # the best paths, from the ends
        used, at, own, steps = np.full(size, -1, dtype=np.int64), last.copy(), np.arange(len(some)), []
        while len(own):
            here = at[own]
            steps.append((own, back_id[here]))
            used[back[here]] = here
            at[own] = back[here]
            own = own[at[own] != first[own]]
        n = np.zeros(len(some), dtype=np.int64)
        for own, _ in steps:
            n[own] += 1
        stop = np.cumsum(n)
        flat = np.zeros(int(stop[-1]), dtype=np.int64)
        for k, (own, x) in enumerate(steps):
            flat[stop[own] - 1 - k] = x
        # another path takes an edge that the best one doesn't
        total = np.where(used[start] == end, -np.inf, best[start] + score + rest[end])
        second = np.full(len(some), -np.inf)
        np.maximum.at(second, np.searchsorted(first, start, side="right") - 1, total)
        body, top = flat.astype("<u4").tobytes(), best[last]
        found = zip(some, top.tolist(), (4 * (stop - n)).tolist(), (4 * stop).tolist(), (top - second).tolist())
        self.chunks.update((c, (b, body[x:y], loss)) for c, b, x, y, loss in found)
        for i in np.unique(np.searchsorted(stop, np.flatnonzero(flat < 0), side="right")).tolist():  # bytes for what is no piece
            b, _, loss = self.chunks[some[i]]
            own = [x.to_bytes(4, "little") if x >= 0 else self.bytes_of(chr(-1 - x)) for x in flat[stop[i] - n[i] : stop[i]].tolist()]
            self.chunks[some[i]] = (b, b"".join(own), loss)

    def bytes_of(self, char: str) -> bytes:
        """The ids of a character's bytes."""
        own = SPACE if char == OWN_SPACE else char
        return b"".join([self.byte_ids[x].to_bytes(4, "little") for x in own.encode("utf-8", "replace")])

    def lattice(self, part: str) -> tuple[list[Edge], list[float], list[Edge | None]]:
        """All edges by their start, the forward Viterbi scores, and the best edge into each position."""
        size, table = len(part), self.table
        best, back = [0.0] + [float("-inf")] * size, [None] * (size + 1)
        edges: list[Edge] = []
        for i in range(size):
            b = best[i]
            for j in range(i + 1, size + 1):
                found = table.get(part[i:j], 0)
                if found is None:
                    continue
                if found == 0:
                    break
                edges.append(edge := (i, j, *found))
                if b + found[0] > best[j]:
                    best[j], back[j] = b + found[0], edge
            if part[i] not in self.pieces:
                edges.append(edge := (i, i + 1, self.unknown, self.bytes_of(part[i])))
                if b + self.unknown > best[i + 1]:
                    best[i + 1], back[i + 1] = b + self.unknown, edge
        return edges, best, back

    def search(self, part: str) -> Iterator[Segmentation]:
        """The n best segmentations of a part, best first: backward A* with the forward scores as exact heuristics.

        An agenda entry is an edge into a place from which a tail leads to the end; edges into a place follow one another
        by what they can reach, and the next comes up when the one before is taken. Of equal entries the one nearer to the
        start goes first, so that ties don't widen the search. A place is passed n times at most: the n best of the whole
        take one of its n best tails. Tails are chains of edges, joined only once they are complete."""
        edges, best, _ = self.lattice(part)
        into: list[list[tuple[float, int, float, bytes]]] = [[] for _ in best]
        for start, end, score, own in edges:
            into[end].append((-(best[start] + score), start, score, own))
        ordered, passed, tick = [False] * len(best), [0] * len(best), count()
        agenda: list[tuple] = []

        def offer(at: int, k: int, tail: float, chain) -> None:
            """The k-th best edge into a place, before the tail from there on."""
            if not ordered[at]:
                into[at].sort(key=lambda e: e[:2])
                ordered[at] = True
            if k < len(into[at]):
                cost, start, _, _ = into[at][k]
                heapq.heappush(agenda, (cost - tail, start, next(tick), at, k, tail, chain))

        offer(len(part), 0, 0.0, None)
        while agenda:
            _, start, _, at, k, tail, chain = heapq.heappop(agenda)
            offer(at, k + 1, tail, chain)
            if passed[start] < self.n:
                passed[start] += 1
                _, _, score, own = into[at][k]
                chain = (own, chain)
                if start:
                    offer(start, 0, tail + score, chain)
                else:
                    ids = []
                    whole = chain
                    while whole:
                        ids.append(whole[0])
                        whole = whole[1]
                    yield tail + score, b"".join(ids)
                    if passed[0] == self.n:
                        return

    def part(self, part: str) -> Part:
        """The best segmentation of a part and what the second best loses against it."""
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) > self.most:
                self.parts.clear()
            edges, best, back = self.lattice(part)
            rest = [float("-inf")] * len(part) + [0.0]  # the best score from each position to the end
            for i, j, score, _ in reversed(edges):
                if score + rest[j] > rest[i]:
                    rest[i] = score + rest[j]
            at, ids, used = len(part), [], set()
            while at:
                edge = back[at]
                used.add(edge[:2])
                ids.append(edge[3])
                at = edge[0]
            # another path takes an edge that the best one doesn't
            second = max((best[i] + score + rest[j] for i, j, score, _ in edges if (i, j) not in used), default=float("-inf"))
            found = (best[-1], b"".join(reversed(ids)), best[-1] - second)
            if len(part) <= KEPT:
                self.parts[part] = found
        return found

    def cut(self, chunk: str) -> list[str]:
        """The chunk's parts: no piece spans two of them."""
        out, at, pairs = [], 0, self.pairs
        for k in range(1, len(chunk)):
            if chunk[k - 1 : k + 1] not in pairs:
                out.append(chunk[at:k])
                at = k
        return [*out, chunk[at:]] if chunk else []

    def chunk(self, chunk: str) -> Part:
        """As part(), for text between spaces."""
        found = self.chunks.get(chunk)
        if found is None:
            if len(self.chunks) > self.most:
                self.chunks.clear()
            own = [self.part(p) for p in self.cut(chunk)]
            found = own[0] if len(own) == 1 else (sum([x[0] for x in own]), b"".join([x[1] for x in own]), min([x[2] for x in own]))
            if len(chunk) <= KEPT:
                self.chunks[chunk] = found
        return found

    def merged(self, names: list[str], bests: list[Part], every: Callable[[str], list[Segmentation]]) -> list[Segmentation]:
        """The n best sums of one segmentation of each name. Only the n - 1 with the least loss can differ from their best."""
        scores, bodies, losses = zip(*bests)
        left, near = list(losses), []
        for _ in range(self.n - 1):
            if (least := min(left)) == float("inf"):  # the others have one segmentation
                break
            near.append(left.index(least))
            left[near[-1]] = float("inf")
        combos: list[tuple[float, tuple[tuple[int, bytes], ...]]] = [(0.0, ())]
        for i in near:
            own = every(names[i])
            combos = sorted((c + own[0][0] - s, (*m, (i, ids))) for c, m in combos for s, ids in own)[: self.n]
        total = sum(scores)
        out = []
        for cost, changes in combos:
            ids = list(bodies) if changes else bodies
            for i, other in changes:
                ids[i] = other
            out.append((total - cost, b"".join(ids)))
        return out

    def part_nbest(self, part: str) -> list[Segmentation]:
        return [s for s, _ in zip(self.search(part), range(self.n))]

    def chunk_nbest(self, chunk: str) -> list[Segmentation]:
        """The n best of a chunk; those of short ones are kept, since the chunks that lose least are few and common."""
        found = self.several.get(chunk)
        if found is None:
            parts = self.cut(chunk)
            found = self.merged(parts, [self.part(p) for p in parts], self.part_nbest)
            if len(chunk) <= LONG:
                if len(self.several) > self.most // 4:
                    self.several.clear()
                self.several[chunk] = found
        return found

    def split(self, text: str) -> list[str]:
        """The chunks of a text: words with the spaces before them, and spaces at the end."""
        if SPACE in text:
            text = text.replace(SPACE, OWN_SPACE)
        words = text.split(" ")
        if "" not in words:
            chunks = [SPACE + w for w in words]
        else:
            chunks, spaces = [], ""
            for word in words:
                spaces += SPACE
                if word:
                    chunks.append(spaces + word)
                    spaces = ""
            if spaces:
                chunks.append(spaces)
        # the space before a chunk parts it from the last one unless a piece holds the pair
        return ["".join(chunks)] if self.joined else chunks

    def encode(self, text: str) -> list[Segmentation]:
        return next(self.encode_batch([text]))

    def encode_batch(self, texts: list[str]) -> Iterator[list[Segmentation]]:
        """The n best segmentations of each whole text, best first; an empty text has the empty one only."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.chunks) > self.most:
            self.chunks.clear()
        self.learn(list({c for chunks in split for c in chunks}.difference(self.chunks)))
        for chunks in split:
            try:
                bests = list(map(self.chunks.__getitem__, chunks))
            except KeyError:  # long words
                bests = [self.chunk(c) for c in chunks]
            yield self.merged(chunks, bests, self.chunk_nbest) if chunks else [(0.0, b"")]

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_nbest(docs: DataFrame, model_path: str, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and rank: doc_id, rank (from 1), score, n_pieces, ids (array), decoded (text).

    Null texts are empty: one empty segmentation. Null ids stay null; repeated rows are encoded each; an empty table
    gives an empty result; other columns are ignored. A text with fewer segmentations has fewer rows.
    """
    return _ranked(docs, model_path, n, id_col, text_col, digest=False)


def groups(texts: list[str], most: int = 2_000_000) -> Iterator[list[str]]:
    """The texts in order, some megabytes at a time."""
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def _ranked(docs: DataFrame, model_path: str, n: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    tail = [("ids_crc32", pa.int64()), ("round_trip", pa.bool_())] if digest else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    schema = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("n_pieces", pa.int64()), *tail])

    def run(batches):
        model = PieceModel(model_path, n=n)
        for batch in batches:
            at = 0
            for texts in groups([t or "" for t in batch.column(1).to_pylist()]):  # some documents' ids at a time
                rows = []
                docs = batch.column(0).slice(at, len(texts)).to_pylist()
                at += len(texts)
                for doc, text, found in zip(docs, texts, model.encode_batch(texts)):
                    for rank, (score, ids) in enumerate(found, 1):
                        decoded = model.decode(ids)
                        more = (zlib.crc32(ids), decoded == text) if digest else (np.frombuffer(ids, "<u4").tolist(), decoded)
                        rows.append((doc, rank, score, len(ids) // 4, *more))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    kinds = "ids_crc32 long, round_trip boolean" if digest else "ids array<int>, decoded string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), f"doc_id long, rank int, score double, n_pieces long, {kinds}")


def piece_query(docs: DataFrame, model_path: str, n: int = 3) -> DataFrame:
    """The n best segmentations of every document, as digests: doc_id, rank, score, n_pieces, ids_crc32, round_trip."""
    return _ranked(docs, model_path, n, "doc_id", "text", digest=True)
