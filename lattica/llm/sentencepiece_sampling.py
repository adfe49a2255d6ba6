"""Operator 1: sampled SentencePiece encodings by Gumbel top-k without replacement, and decoding.

The segmentations of a text are the paths of a lattice of pieces. A path's weight is the product of its pieces' weights:
e^score of a unigram model, or, where a BPE model's scores are mere ranks, 1 / (3 + rank). A perturbed A* search emits the k paths of
largest log probability plus Gumbel noise, which is a sample of k distinct paths without replacement. The queue holds
regions of paths, each bounded by its largest perturbed value, drawn top down: a region's best path keeps the value; what
it leaves at each of its nodes becomes a region with a Gumbel value cut off at that bound. With kappa the (k+1)th
value, a path of log probability f is included with probability 1 - exp(-exp(f - kappa)); its logarithm is the inclusion score.

No piece reaches over the start of a run of blanks or over a line break, so the lattice of a text is a chain of lattices of its
words, and those of common words are kept. All noise is hashed from the row's key, the sample's number and the place, so
results depend on neither batches nor partitions.

Defined results: null text is the empty text, with one segmentation of no pieces; a text with fewer than k segmentations
gives all of them, each included for certain; characters without a piece become byte pieces; rows with equal keys and texts get
equal samples; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import tokenizer_path
from .common import in_arrow, map_arrow, table
from .words import HashTable, U, hash_ranges, mix, row_groups, text_bytes

K = 3
BLANK = "▁"
CACHE_EDGES = 3_500_000
FIRST_STEPS = 400
GROUP_BYTES = 1 << 20
PREFIX = 1 << 40  # what is no piece but starts one
STEP = U(0xD6E8FEB86659FD93)
FIGURES = ("n_pieces", "ids_crc32", "log_prob", "perturbed", "log_inclusion", "round_trip")


def unit(x: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((x >> U(12)).astype(np.float64) + 0.5) * 2.0**-52


class Flat:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.room, self.size = np.zeros(1024, dtype=kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            wider = np.zeros(max(end, len(self.room) * 5 // 4), dtype=self.room.dtype)
            wider[: self.size] = self.room[: self.size]
            self.room = wider
        self.room[self.size : end] = values
        self.size = end

    def view(self) -> np.ndarray:
        return self.room[: self.size]


class Lattices:
    """The lattices of words, as flat arrays of nodes and edges, made for many new words at once; forgotten together when there are many.

    A word's nodes are its characters, one after another; an edge is a piece from a character to where the piece ends.
    """

    def __init__(self, path: str, theta: float = 1.0) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        scores = [model.get_score(i) for i in range(n)]
        ranks = all(float(s).is_integer() for s in scores)
        self.piece_bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        weight = np.zeros(n)
        known: dict[int, int] = {}  # hash of a piece or of the start of one -> its id, or PREFIX
        self.longest = 1
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[1:-1], 16)
                self.byte_ids[b] = i
                self.piece_bytes.append(bytes([b]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.piece_bytes.append(b"")
                continue
            else:
                if BLANK in piece.lstrip(BLANK) or "\n" in piece:
                    raise ValueError("a piece of this model reaches over the start of a word")
                self.piece_bytes.append(piece.replace(BLANK, " ").encode())
                h = 0
                for c in piece:
                    h = (h + ord(c) + 1) * int(STEP) & (2**64 - 1)
                    known.setdefault(h, PREFIX)
                known[h] = i
                self.longest = max(self.longest, len(piece))
            weight[i] = -np.log(3.0 + min(-scores[i], n)) if ranks else scores[i]
        self.weight = theta * weight
        self.byte_weight = -theta * np.log(3.0 + n) if ranks else float(self.weight.min())
        self.pieces = HashTable()
        self.pieces.add(mix(np.array(list(known), dtype=U)), np.array(list(known.values())))
        self.piece_size = np.array([len(x) for x in self.piece_bytes], dtype=np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.all_bytes = np.frombuffer(b"".join(self.piece_bytes), dtype=np.uint8)
        self.clear()

    def clear(self) -> None:
        self.at = HashTable()  # hash of a word -> its first node
        self.first, self.count = Flat(np.int64), Flat(np.int64)  # of nodes
        self.next, self.logp, self.node, self.only, self.cum = Flat(np.int32), Flat(float), Flat(np.int32), Flat(np.int32), Flat(float)  # of edges

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word of texts that begin with a blank, and the number of words of each text.

        A word is a run of blanks with what follows up to the next blank or line break; a line break is one of its own.
        """
        blank, line = data == 0x20, data == 0x0A
        start = line.copy()
        start[1:] |= (blank[1:] & ~blank[:-1]) | (~blank[1:] & line[:-1])
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], len(data))[: len(starts)], np.diff(np.searchsorted(starts, offsets))

    def nodes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The first node of each word."""
        keys = hash_ranges(data, starts, ends)
        at = self.at.find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first, inverse = np.unique(keys[missing], return_index=True, return_inverse=True)
            rows = missing[first]
            size = ends[rows] - starts[rows]
            joined = data[np.repeat(starts[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            letters = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])
            stop = letters[np.cumsum(size)]
            nodes = self._add(np.frombuffer(joined.tobytes().decode().encode("utf-32-le"), dtype=np.uint32).astype(np.int64), stop)
            self.at.add(new, nodes)
            at[missing] = nodes[inverse]
        return at

    def _add(self, points: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The first nodes of new words, given as the code points of all of them and where each ends."""
        n = len(points)
        begin = np.concatenate([[0], stop[:-1]])
        end = np.repeat(stop, stop - begin)  # of each character's word
        code = np.where(points == 0x20, ord(BLANK), points).astype(U) + U(1)
        # Pieces from each character, by length: characters go on while what was read so far starts some piece.
        here, h = np.arange(n), np.zeros(n, dtype=U)
        found = []  # (character, length, id, weight)
        for length in range(1, self.longest + 1):
            h = (h + code[here + length - 1]) * STEP
            piece = self.pieces.find(mix(h))
            hit = (piece >= 0) & (piece != PREFIX)
            ids, own = piece[hit], here[hit]
            found.append((own, np.full(len(own), length), ids, self.weight[ids]))
            if length == 1:  # a character without a piece is its bytes
                bare = here[~hit]
                wide = points[bare]
                bytes_ = 1 + (wide > 0x7F).astype(np.int64) + (wide > 0x7FF) + (wide > 0xFFFF)
                ids = np.where(wide < 0x80, np.array(self.byte_ids)[np.minimum(wide, 0x7F)], -1 - wide)
                found.append((bare, np.ones(len(bare), dtype=np.int64), ids, self.byte_weight * bytes_))
            on = (piece >= 0) & (here + length < end[here])
            here, h = here[on], h[on]
            if not len(here):
                break
        node, length, ids, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(node, kind="stable")
        node, length, ids, weight = node[order], length[order], ids[order], weight[order]
        count = np.bincount(node, minlength=n)
        first = np.cumsum(count) - count
        # beta: log of the sum of weights of all ways from a node to its word's end, nearest nodes first
        beta, distance = np.zeros(n + 1), end - np.arange(n)
        by = np.argsort(distance, kind="stable")
        borders = np.searchsorted(distance[by], np.arange(1, int(distance.max()) + 2))
        target = np.where(node + length < end[node], node + length, n)
        counts_by = count[by]
        edges_by = np.repeat(first[by] - np.cumsum(counts_by) + counts_by, counts_by) + np.arange(len(node))
        edge_border = np.concatenate([[0], np.cumsum(counts_by)])
        total = weight.copy()
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            if a == b:
                continue
            lo, hi = edge_border[a], edge_border[b]
            e, cuts = edges_by[lo:hi], edge_border[a:b] - lo
            z = weight[e] + beta[target[e]]
            total[e] = z
            top = np.maximum.reduceat(z, cuts)
            beta[by[a:b]] = top + np.log(np.add.reduceat(np.exp(z - np.repeat(top, counts_by[a:b])), cuts))
        logp = total - beta[node]
        p, rank = np.exp(logp), np.arange(len(node)) - first[node]
        cum = p.copy()
        for r in range(1, int(count.max())):
            at = np.flatnonzero(rank == r)
            cum[at] += cum[at - 1]
        base, base_edge = self.first.size, self.next.size
        self.first.extend(first + base_edge)
        self.count.extend(count)
        self.next.extend(np.where(target < n, target + base, -1))
        for held, values in ((self.logp, logp), (self.node, node + base), (self.only, ids), (self.cum, cum)):
            held.extend(values)
        return begin + base

    def arrays(self) -> tuple[np.ndarray, ...]:
        """first and count of nodes; next, logp, node, id (below 0: -1 - a code point that is its bytes) and cumulative probability of edges."""
        return self.first.view(), self.count.view(), self.next.view(), self.logp.view(), self.node.view(), self.only.view(), self.cum.view()

    def ids(self, edges: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of paths that stand one after another, and how many each has."""
        own = self.only.view()[edges]
        wide = np.flatnonzero(own < 0)
        if not len(wide):
            return own.astype(np.int32), sizes
        bytes_ = [chr(-1 - c).encode() for c in own[wide].tolist()]
        times = np.ones(len(own), dtype=np.int64)
        times[wide] = [len(b) for b in bytes_]
        out = np.repeat(own, times)
        out[out < 0] = [self.byte_ids[x] for b in bytes_ for x in b]
        return out.astype(np.int32), np.diff(np.concatenate([[0], np.cumsum(times)])[np.concatenate([[0], np.cumsum(sizes)])])

    def text_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of pieces, one after another, and how many each has."""
        size = self.piece_size[ids]
        return self.all_bytes[np.repeat(self.piece_start[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())], size


def walk(lat: Lattices, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ancestral samples of many words at once, from node to the word's end: (word, edge, hash) of each step, word after word.

    seed is the noise of each word; the choice at its s-th step and the noise for what is left there are hashed from it.
    """
    first, count, nxt, _, _, _, cum = lat.arrays()
    steps, place, length = [], np.arange(len(node)), np.zeros(len(node), dtype=np.int64)
    with np.errstate(over="ignore"):
        while len(node):
            h = mix(seed + U(len(steps) + 1) * U(0x9E3779B97F4A7C15))
            edge, u = first[node], unit(h)
            last = edge + count[node] - 1
            open_ = np.flatnonzero((u > cum[edge]) & (edge < last))
            while len(open_):
                edge[open_] += 1
                at = edge[open_]
                open_ = open_[(u[open_] > cum[at]) & (at < last[open_])]
            length[place] += 1
            steps.append((place, edge, h))
            on = nxt[edge]
            alive = np.flatnonzero(on >= 0)
            node, place, seed = on[alive], place[alive], seed[alive]
    start = np.cumsum(length) - length
    total = int(length.sum())
    edges, hashes = np.empty(total, dtype=np.int64), np.empty(total, dtype=U)
    for s, (p, e, h) in enumerate(steps):
        edges[start[p] + s] = e
        hashes[start[p] + s] = h
    return np.repeat(np.arange(len(length)), length), edges, hashes


def left_over(mu: np.ndarray, u: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Gumbel values of location mu, cut off at bound."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(mu), -np.inf, mu - np.logaddexp(mu - bound, np.log(-np.log(u))))


class Path:
    """A sampled path: the edge of each step, the place (word) it is in, and log probabilities before it."""

    __slots__ = ("edges", "places", "before", "value", "logp")

    def __init__(self, edges: np.ndarray, places: np.ndarray, logp: np.ndarray, value: float) -> None:
        self.edges, self.places, self.value = edges, places, value
        total = np.cumsum(logp[edges]) if len(edges) else np.zeros(0)
        self.logp = float(total[-1]) if len(edges) else 0.0
        self.before = total - logp[edges] if len(edges) else total


def blank_first(column: pa.Array) -> pa.Array:
    """Texts with a blank before those that aren't empty, as the model's own encoder puts one; its blank symbol in a text is a blank."""
    texts = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), BLANK, " ")
    return pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))


def sample_batch(lat: Lattices, data: np.ndarray, offsets: np.ndarray, keys: list[int], k: int = K) -> list[tuple[list[Path], float]]:
    """For each text (made by blank_first) its k sampled paths, best first, and kappa (minus infinity if there are no further paths)."""
    begin, end, words = lat.words(data, offsets)
    starts = np.split(lat.nodes(data, begin, end), np.cumsum(words)[:-1])
    texts = range(len(words))
    first, count, nxt, logp, node_of, _, _ = lat.arrays()
    single = count[node_of] == 1
    own = np.array(keys, dtype=U)
    paths: list[list[Path]] = [[] for _ in texts]
    queues: list[list[tuple]] = [[] for _ in texts]  # (-value, order, path, step, edges taken there)
    kappa = [-np.inf] * len(texts)
    jobs = [(d, -1.0, None, 0, -1) for d in range(len(texts))]  # text, value, path to leave, at step, edge to take there
    with np.errstate(over="ignore"):
        roots = -np.log(-np.log(unit(mix(own ^ U(0x2545F4914F6CDD1D)))))
        for number in range(k):
            node_parts, place_parts, heads = [], [], []
            for d, value, path, step, edge in jobs:
                if path is None:
                    at, words_from = starts[d], 0
                    head = np.zeros(0, np.int64), np.zeros(0, np.int64)
                else:
                    here = path.places[step]
                    head = np.append(path.edges[:step], edge), path.places[: step + 1]
                    words_from = int(here) + 1
                    at = starts[d][words_from:]
                    if nxt[edge] >= 0:
                        at, words_from = np.concatenate([[nxt[edge]], at]), int(here)
                node_parts.append(at)
                place_parts.append(np.arange(words_from, words_from + len(at)))
                heads.append(head)
            sizes = [len(x) for x in node_parts]
            doc = np.repeat(np.arange(len(jobs)), sizes)
            node = np.concatenate(node_parts) if jobs else np.zeros(0, np.int64)
            place = np.concatenate(place_parts) if jobs else np.zeros(0, np.int64)
            of = np.array([j[0] for j in jobs], dtype=np.int64)
            seed = mix(mix(own[of][doc] + U(number + 1) * U(0xD1342543DE82EF95)) + place.astype(U) * U(0xE7037ED1A0B428DB))
            row, edge, hashes = walk(lat, node, seed)
            borders = np.searchsorted(doc[row], np.arange(len(jobs) + 1))
            values = np.array([roots[d] if path is None else value for d, value, path, _, _ in jobs])
            sums = np.array([logp[e].sum() for e, _ in heads])
            # What the first steps leave, of all texts at once. Noise is within (-4, 37) by its 52 bits: where the best k + 1 are
            # above all that later steps could reach, those can't matter; elsewhere all steps are looked at.
            at = borders[:-1, None] + np.arange(FIRST_STEPS)
            valid = at < borders[1:, None]
            at = np.where(valid, at, 0)
            best, reach = _leaves(edge[at] if len(edge) else at, hashes[at] if len(edge) else at.astype(U), valid, sums, values, logp, single)
            order = np.argsort(-best, axis=1, kind="stable")[:, : k + 1]
            worst = np.take_along_axis(best, order[:, -1:], axis=1)[:, 0]
            more = (borders[1:] - borders[:-1] > FIRST_STEPS) & (worst <= reach + 37)
            for q, (d, _, path, _, _) in enumerate(jobs):
                a, b = borders[q], borders[q + 1]
                head_edges, head_places = heads[q]
                new = Path(np.concatenate([head_edges, edge[a:b]]), np.concatenate([head_places, place[row[a:b]]]), logp, float(values[q]))
                paths[d].append(new)
                g, top = best[q], order[q]
                if more[q]:
                    g = _leaves(edge[None, a:b], hashes[None, a:b], np.ones((1, b - a), dtype=bool), sums[q : q + 1], values[q : q + 1], logp, single)[0][0]
                    top = np.argsort(-g, kind="stable")[: k + 1]
                h = len(head_edges)
                for i in top.tolist():
                    if g[i] > -np.inf:
                        heapq.heappush(queues[d], (-float(g[i]), len(paths[d]), i, new, h + i, (int(edge[a + i]),)))
            jobs = []
            for d in range(len(texts)):
                if len(paths[d]) != number + 1 or not queues[d]:
                    continue
                g, _, _, path, step, taken = heapq.heappop(queues[d])
                if number == k - 1:
                    kappa[d] = -g
                    continue
                e, left, v = choose(first, count, logp, node_of, path.edges[step], taken, int(own[d]), number, step)
                if left > -np.inf:
                    mu = path.before[step] + left
                    value = float(left_over(np.array([mu]), np.array([v]), np.array([-g]))[0])
                    heapq.heappush(queues[d], (-value, len(paths[d]) + 1, step, path, step, (*taken, e)))
                jobs.append((d, -g, path, step, e))
    return list(zip(paths, kappa, strict=True))


def _leaves(edges, hashes, valid, sums, values, logp, single) -> tuple[np.ndarray, np.ndarray]:
    """Cut-off Gumbel values of what each step leaves (texts x steps), and the log probability that the steps reach."""
    f = np.where(valid, logp[edges] if len(logp) else 0.0, 0.0)
    after = sums[:, None] + np.cumsum(f, axis=1)
    mass = after - f + np.log(np.maximum(-np.expm1(np.minimum(f, 0.0)), 1e-300))
    mass = np.where(valid & ~(single[edges] if len(single) else valid), mass, -np.inf)
    u = unit(mix(hashes ^ U(0xA0761D6478BD642F)))
    return left_over(mass, u, np.broadcast_to(values[:, None], mass.shape)), after[:, -1]


def choose(first: np.ndarray, count: np.ndarray, logp: np.ndarray, node_of: np.ndarray, edge: int, taken: tuple[int, ...], key: int, number: int, step: int) -> tuple[int, float, float]:
    """Another edge of the node of `edge`, by probability among those not taken; the log probability then left (minus infinity: no edge is), and noise for it."""
    node = int(node_of[edge])
    start = int(first[node])
    edges = [e for e in range(start, start + int(count[node])) if e not in taken]
    own = logp[edges].tolist()
    top = max(own)
    p = [exp(x - top) for x in own]
    h = _mix(_mix(key ^ 0x8EBC6AF09C88C6E3) + (number * 1_000_003 + len(taken)) * 0x589965CC75374CC3 + step)
    u, v = (((x >> 12) + 0.5) * 2.0**-52 for x in (h, _mix(h ^ 0xA0761D6478BD642F)))
    u, k = u * sum(p), 0
    while k < len(p) - 1 and u > p[k]:
        u -= p[k]
        k += 1
    rest = sum(p[:k]) + sum(p[k + 1 :])
    if rest > 0:
        left = top + log(rest)
    else:  # all that is left is too unlikely beside the edge taken to show in the sum
        left = float(np.logaddexp.reduce(np.delete(own, k))) if len(own) > 1 else -np.inf
    return edges[k], left, v


def _mix(x: int) -> int:
    """mix() of one number."""
    x &= 2**64 - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def log_inclusion(logp: float, kappa: float) -> float:
    """log(1 - exp(-exp(logp - kappa)))."""
    if kappa == -np.inf:
        return 0.0
    x = logp - kappa
    return float(x - 0.5 * np.exp(x)) if x < -20 else float(np.log(-np.expm1(-np.exp(min(x, 50.0)))))


def decode(ids: list[int], piece_bytes: list[bytes]) -> str:
    """The text of ids: pieces joined, byte pieces as bytes, without the blank that encoding puts before a text."""
    return b"".join([piece_bytes[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


_LATTICES: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, theta: float) -> Lattices:
    if (path, theta) not in _LATTICES:
        _LATTICES[path, theta] = Lattices(path, theta)
    if _LATTICES[path, theta].next.size > CACHE_EDGES:
        _LATTICES[path, theta].clear()
    return _LATTICES[path, theta]


def encode_batch(lat: Lattices, column: pa.Array, keys: list[int], k: int = K) -> dict[str, np.ndarray]:
    """Samples of all texts of a column: text (its number), sample, n_pieces, ids (of all, one after another), and their figures."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    (data, offsets), (plain, at) = text_bytes(blank_first(texts)), text_bytes(texts)
    found = sample_batch(lat, data, offsets, keys, k)
    paths = [p for own, _ in found for p in own]
    text = np.repeat(np.arange(len(found)), [len(own) for own, _ in found])
    ids, sizes = lat.ids(np.concatenate([np.zeros(0, dtype=np.int64), *(p.edges for p in paths)]), np.array([len(p.edges) for p in paths], dtype=np.int64))
    stops = np.cumsum(sizes)
    whole, width = lat.text_of(ids)
    ends = np.concatenate([[0], np.cumsum(width)])[stops]
    packed, trip, crc, a, b = memoryview(ids.view(np.uint8)), np.zeros(len(paths), dtype=bool), np.zeros(len(paths), dtype=np.int64), 0, 0
    for j, (t, stop, end) in enumerate(zip(text.tolist(), stops.tolist(), ends.tolist(), strict=True)):
        crc[j] = zlib.crc32(packed[4 * a : 4 * stop])
        blank = 1 if at[t + 1] > at[t] else 0
        trip[j] = end - b == at[t + 1] - at[t] + blank and np.array_equal(whole[b + blank : end], plain[at[t] : at[t + 1]])
        a, b = stop, end
    logp, kappa = np.array([p.logp for p in paths]), np.repeat([x for _, x in found], [len(own) for own, _ in found])
    sample = np.concatenate([np.zeros(0, dtype=np.int64), *(np.arange(len(own)) for own, _ in found)])
    return {"text": text, "sample": sample, "ids": ids, "n_pieces": sizes, "ids_crc32": crc, "log_prob": logp, "perturbed": np.array([p.value for p in paths]), "log_inclusion": np.array([log_inclusion(x, y) for x, y in zip(logp.tolist(), kappa.tolist(), strict=True)]), "round_trip": trip}


def sampled_encodings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, k: int = K, theta: float = 1.0) -> DataFrame:
    """doc_id, sample, ids, n_pieces, ids_crc32, log_prob, perturbed, log_inclusion, round_trip: k rows for a row of df, or as many as it has segmentations."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [x & (2**64 - 1) for x in b.column(2).to_pylist()]
            for lo, hi in row_groups(text_bytes(b.column(1))[1], GROUP_BYTES):
                got = encode_batch(lattices(path, theta), b.column(1).slice(lo, hi - lo), keys[lo:hi], k)
                ends = np.concatenate([[0], np.cumsum(got["n_pieces"])])
                columns = [b.column(0).take(pa.array(got["text"] + lo)), pa.array(got["sample"], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(got["ids"])), *(pa.array(got[n]) for n in FIGURES)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sample", "ids", *FIGURES])

    schema = f"doc_id {kind}, sample int, ids array<int>, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean"
    return in_arrow(df.select(F.col(id_col), F.col(text_col).cast("string"), F.xxhash64(F.col(id_col).cast("string"))), run, schema)


def decoded(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, text of each row's ids; null ids are null text."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    kind = df.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pieces = lattices(path, 1.0).piece_bytes
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else decode(x, pieces) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_arrow(df.select(F.col(id_col), F.col(ids_col)), run, f"doc_id {kind}, text string")


def op1_sentencepiece_gumbel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_encodings(table(spark, sf_dir, "documents"))
