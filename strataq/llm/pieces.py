"""SentencePiece encoding and decoding with seeded merge-dropout.

Byte-pair merges run over an agenda ordered by piece score. A candidate merge that comes up is
skipped for good if a keyed hash of (seed, document, unit and its place, place in the unit, both
parts) falls below the dropout rate, so a seed gives the same segmentation anywhere, and other seeds
give others. Units are runs of spaces with the text that follows: no piece crosses their bounds,
which is checked when a model is loaded. Every occurrence of a unit draws for itself; those that
skip the same steps are merged once, many at a time in numpy.
Characters without a piece, and a literal U+2581, become byte pieces: decoding is lossless. A text of
any length is encoded whole; one beyond BATCH_CHARS is a batch of its own, some hundred bytes a character.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm.textstats import unpacked
from strataq.storage import read_table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = "▁", "\udc81"  # the second, no character of any text, stands for a literal U+2581
#: In the arrays of a merge: no merge, and no part.
NEVER = NONE = 65535
LONG_UNIT = 48
BATCH_CHARS = 2 << 20
ROWS = 50_000
CACHED = 2_000_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Pieces:
    """Tables of a BPE model with byte fallback, from the bytes of its file."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {t: i for i, t in enumerate(self.text) if plain[i]}
        self.byte_id = {int(t[1:-1], 16): i for i, t in enumerate(self.text) if sp.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        if any("\n" in t or SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("a piece crosses the bounds of units")
        # Single characters that only occur inside pieces can still be merged; they get numbers of their own.
        chars = sorted({c for t in self.ids for c in t} - set(self.ids))
        self.char_id = {c: i for c, i in self.ids.items() if len(c) == 1} | {c: n + k for k, c in enumerate(chars)}
        self.size = n + len(chars)
        if self.size >= NONE:
            raise ValueError("the model has too many pieces")
        # By code point; the last is for -1.
        self.char_part = np.full(0x110001, self.size, np.uint16)
        self.char_part[[ord(c) for c in self.char_id]] = list(self.char_id.values())
        self.char_part[-1] = NONE
        by_score = sorted(self.ids.values(), key=lambda i: (-sp.get_score(i), i))
        rank = np.full(n, NEVER, np.uint16)
        rank[by_score] = np.arange(len(by_score))
        pairs = {}
        known = self.ids | self.char_id
        for t, i in self.ids.items():
            for k in range(1, len(t)):
                a, b = known.get(t[:k]), known.get(t[k:])
                if a is not None and b is not None:
                    pairs[(a << 16) + b] = i
        # Pairs by hash; those whose slot is taken go on to another table.
        keys, ranks = np.array(sorted(pairs), np.int64), rank[[pairs[k] for k in sorted(pairs)]]
        self.tables = []
        while len(keys):
            bits = max(8, int(len(keys)).bit_length() + 2)
            table, found = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.uint16)
            slot = self._slot(keys, len(self.tables), bits)
            table[slot], found[slot] = keys, ranks
            lost = table[slot] != keys
            found[slot[~lost]] = ranks[~lost]
            self.tables.append((bits, table, found))
            keys, ranks = keys[lost], ranks[lost]
        self.pairs = pairs
        self.rank = rank
        self.by_rank = np.array(by_score, np.uint16)
        raw = [bytes([int(t[1:-1], 16)]) if sp.is_byte(i) else t.replace(SPACE, " ").encode() if plain[i] else b"" for i, t in enumerate(self.text)]
        self.raw_start = np.cumsum([0, *map(len, raw)])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of parts ``a`` and ``b``; NEVER where there is none."""
        key = (a.astype(np.int64) << 16) + b
        out = np.full(key.shape, NEVER, np.uint16)
        for k, (bits, table, found) in enumerate(self.tables):
            slot = self._slot(key, k, bits)
            out = np.where(table[slot] == key, found[slot], out)
        return out

    @staticmethod
    def _slot(key: np.ndarray, k: int, bits: int) -> np.ndarray:
        return ((key.view(_U) * _U((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)[k % 2] + 2 * k)) >> _U(64 - bits)).view(np.int64)


@lru_cache(2)
def load(proto: bytes) -> Pieces:
    return Pieces(proto)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(max(n, 1), 0x9E3779B97F4A7C15, _U))


def _unit_hashes(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of every unit's code points."""
    if not len(starts):
        return np.zeros(0, _U)
    place = _ragged(np.zeros(len(starts), np.int64), sizes)
    return _mix(np.add.reduceat(_mix(points.astype(_U) + _U(0x632BE59BD9B4E019)) * _powers(int(sizes.max()))[place], starts) + sizes.astype(_U))


def _keys(units: np.ndarray, seed: int, stream: np.ndarray) -> np.ndarray:
    return _mix(units ^ _mix(_U(seed & (2**64 - 1)) + (stream.astype(_U) + _U(1)) * _U(0xD1B54A32D192ED03)))


def _occurrence_keys(units: np.ndarray, salts: list[int], per_text: np.ndarray, seed: int) -> np.ndarray:
    """A key for every occurrence of a unit, from its text's salt and its place among the text's units."""
    salt = np.repeat(_mix(np.array([s & (2**64 - 1) for s in salts], _U) + _U(seed & (2**64 - 1))), per_text)
    place = _ragged(np.zeros(len(per_text), np.int64), per_text).astype(_U)
    return _keys(units, seed, _mix(salt + place * _U(0x9E3779B97F4A7C15)))


def _steps(place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return place.astype(_U) * _U(0xA0761D6478BD642F) + a.astype(_U) * _U(0xE7037ED1A0B428DB) + b.astype(_U) * _U(0x8EBC6AF09C88C6E3)


def _falls(x: np.ndarray, dropout: float) -> np.ndarray:
    return (_mix(x) >> _U(11)).astype(np.float64) * 2.0**-53 < dropout


def _skips(key: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray, dropout: float) -> np.ndarray:
    return _falls(key + _steps(place, a, b), dropout)


def merge_many(
    p: Pieces, chars: np.ndarray, key: np.ndarray, dropout: float, skips: np.ndarray | None = None, trail: list | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Merge a matrix of code points, -1 beyond each row's end: part ids (-1 beyond the end) and places.

    Given ``skips``, each row skips the steps of those numbers and draws nothing. ``trail`` takes rows, number and hashes of every step.
    """
    m, width = chars.shape
    # Characters without a piece, numbered p.size, are in no pair; their place tells which they are.
    sym = np.concatenate([p.char_part[chars], np.full((m, 1), NONE, np.uint16)], axis=1)
    place = np.tile(np.arange(width + 1, dtype=np.uint8), (m, 1))
    rank = p.lookup(sym[:, :-1], sym[:, 1:])
    rows, cols = np.arange(m), np.arange(width, dtype=np.int16)
    done_sym, done_place = np.full((m, width), -1, np.int32), np.zeros((m, width), np.uint8)
    step = -1
    while len(rows):
        step += 1
        best = rank.argmin(1)
        at = np.arange(len(rows))
        live = rank[at, best] != NEVER
        if not live.all():
            gone = ~live
            ended = sym[gone, :-1].astype(np.int32)
            ended[ended == NONE] = -1
            done_sym[rows[gone]], done_place[rows[gone]] = ended, place[gone, :-1]
            rows, sym, place, rank, key, best = rows[live], sym[live], place[live], rank[live], key[live], best[live]
            at = np.arange(len(rows))
            if not len(rows):
                break
        a, b = sym[at, best], sym[at, best + 1]
        if skips is not None:
            drop = (skips[rows] == step).any(1)
        else:
            drop = _skips(key, place[at, best], a, b, dropout) if dropout > 0 else np.zeros(len(rows), bool)
        if trail is not None:
            trail.append((rows, step, _steps(place[at, best], a, b)))
        rank[at[drop], best[drop]] = NEVER
        r = at[~drop]
        if len(r):
            j = best[r]
            merged = p.by_rank[rank[r, j]]
            # Close the gap to the right of each merge.
            beyond = cols[None, :] > j[:, None]
            old, old_place, old_rank = sym[r], place[r], rank[r]
            new = np.where(beyond, old[:, 1:], old[:, :-1])
            new[np.arange(len(r)), j] = merged
            np.copyto(old_rank[:, :-1], old_rank[:, 1:].copy(), where=beyond[:, :-1])
            old_rank[:, -1] = NEVER
            right = np.concatenate([new, old[:, -1:]], axis=1)
            for side in (j - 1, j):
                ok = np.flatnonzero(side >= 0)
                s = side[ok]
                old_rank[ok, s] = p.lookup(new[ok, s], right[ok, s + 1])
            sym[r, :-1] = new
            place[r, :-1] = np.where(beyond, old_place[:, 1:], old_place[:, :-1])
            rank[r] = old_rank
    return done_sym, done_place


def merge_one(p: Pieces, unit: str, key: np.ndarray, dropout: float) -> list[tuple[int, int]]:
    """The same for one unit with a heap as agenda, for units too long for a matrix: (part id, place)."""
    part = [p.char_id.get(c, p.size) for c in unit]
    n = len(part)
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if 0 <= i and j < n and part[i] < p.size and part[j] < p.size:
            merged = p.pairs.get((part[i] << 16) + part[j])
            if merged is not None:
                heapq.heappush(agenda, (int(p.rank[merged]), i, j, part[i], part[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while agenda:
        _, i, j, a, b = heapq.heappop(agenda)
        if part[i] != a or part[j] != b or nxt[i] != j:
            continue
        if dropout > 0 and _skips(key, np.array([i]), np.array([a]), np.array([b]), dropout)[0]:
            continue
        part[i], part[j] = p.pairs[(a << 16) + b], -1
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        offer(prev[i], i)
        offer(i, nxt[i])
    return [(x, i) for i, x in enumerate(part) if x >= 0]


def _expand(p: Pieces, unit: str, parts: list[tuple[int, int]]) -> list[int]:
    """Part ids to piece ids: a character without a piece becomes its bytes."""
    out: list[int] = []
    for part, place in parts:
        if part < len(p.text):
            out.append(part)
        else:
            c = unit[place]
            out += [p.byte_id[b] for b in (SPACE if c == LITERAL else c).encode()]
    return out


def segment(
    p: Pieces, points: np.ndarray, first: np.ndarray, sizes: np.ndarray, key: np.ndarray, dropout: float, skips: np.ndarray | None = None, trail: list | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of units (a first code point and a size each), merged under ``key``, as a flat array with counts.

    ``skips`` and ``trail`` are those of ``merge_many``, and only hold for units up to LONG_UNIT.
    """
    counts = np.zeros(len(first), np.int64)
    single: dict[int, np.ndarray] = {}
    order = np.argsort(np.minimum(sizes, NONE).astype(np.uint16), kind="stable")
    short = order[: np.searchsorted(sizes[order], LONG_UNIT, side="right")]
    flats, owners = [], []
    text_of = lambda i: points[first[i] : first[i] + sizes[i]].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    for at in range(0, len(short), ROWS):
        own = short[at : at + ROWS]
        cols = np.arange(int(sizes[own].max()))
        inside = cols[None, :] < sizes[own][:, None]
        chars = np.where(inside, points[np.where(inside, first[own][:, None] + cols[None, :], 0)], -1)
        met: list = []
        sym, place = merge_many(p, chars, key[own], dropout, None if skips is None else skips[own], None if trail is None else met)
        if trail is not None:
            trail += [(own[rows], step, steps) for rows, step, steps in met]
        used = sym >= 0
        odd = np.flatnonzero((sym >= len(p.text)).any(1))
        for k in odd.tolist():
            single[int(own[k])] = np.array(_expand(p, text_of(own[k]), list(zip(sym[k][used[k]].tolist(), place[k][used[k]].tolist()))), np.int32)
        used[odd] = False
        counts[own] = used.sum(1)
        flats.append(sym[used])
        owners.append(own[np.delete(np.arange(len(own)), odd)])
    for i in order[len(short) :].tolist():
        single[i] = np.array(_expand(p, text_of(i), merge_one(p, text_of(i), key[i : i + 1], dropout)), np.int32)
    for i, ids in single.items():
        counts[i] = len(ids)
    starts = np.cumsum(counts) - counts
    flat = np.empty(int(counts.sum()), np.int32)
    for own, part in zip(owners, flats):
        flat[_ragged(starts[own], counts[own])] = part
    for i, ids in single.items():
        flat[starts[i] : starts[i] + counts[i]] = ids
    return flat, counts


class Segments:
    """Segmentations by unit and skipped steps that later batches of a task can use again; dropped as a whole beyond CACHED of them.

    Each comes with the hashes of the steps that led to it, in their order.
    """

    def __init__(self):
        self.key, self.start, self.count, self.flat = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.step_start, self.step_count, self.steps = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is, and whether it is there."""
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return at, self.key[at] == key

    def add(self, key: np.ndarray, flat: np.ndarray, counts: np.ndarray, steps: np.ndarray, step_counts: np.ndarray) -> None:
        """Take in segmentations under keys that are sorted and new."""
        at = np.searchsorted(self.key, key)
        self.start = np.insert(self.start, at, len(self.flat) + np.cumsum(counts) - counts)
        self.count = np.insert(self.count, at, counts)
        self.step_start = np.insert(self.step_start, at, len(self.steps) + np.cumsum(step_counts) - step_counts)
        self.step_count = np.insert(self.step_count, at, step_counts)
        self.key = np.insert(self.key, at, key)
        self.flat = np.concatenate([self.flat, flat])
        self.steps = np.concatenate([self.steps, steps])

    def need(self, p: Pieces, points: np.ndarray, first: np.ndarray, sizes: np.ndarray, key: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """Where each of the sorted keys is, after units that are not there were merged with their steps ``skips`` skipped."""
        new = np.flatnonzero(~self.find(key)[1])
        # What is needed together has to be there together.
        if len(new) and len(self.key) + len(new) > CACHED:
            self.__init__()
            new = np.arange(len(key))
        if len(new):
            trail: list = []
            flat, counts = segment(p, points, first[new], sizes[new], key[new], 0.0, skips[new], trail)
            step_counts = np.zeros(len(new), np.int64)
            for rows, step, _ in trail:
                step_counts[rows] = step + 1
            step_starts = np.cumsum(step_counts) - step_counts
            steps = np.empty(int(step_counts.sum()), _U)
            for rows, step, hashes in trail:
                steps[step_starts[rows] + step] = hashes
            self.add(key[new], flat, counts, steps, step_counts)
        return self.find(key)[0]

    def first_skip(self, at: np.ndarray, key: np.ndarray, since: np.ndarray, dropout: float) -> np.ndarray:
        """Of segmentations ``at`` the first step from ``since`` on that draws under ``key`` skip, or -1."""
        out = np.full(len(at), -1, np.int16)
        for k in range(0, len(at), ROWS):
            some = slice(k, k + ROWS)
            start, n = self.step_start[at[some]], self.step_count[at[some]] - since[some]
            step = _ragged(start + since[some], n)
            owner = np.repeat(np.arange(len(n)), n)
            # From the last to the first, so that the first one stays.
            hit = np.flatnonzero(_falls(key[some][owner] + self.steps[step], dropout))[::-1]
            out[some][owner[hit]] = step[hit] - start[owner[hit]]
        return out


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for every start and count, in one array."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each behind a space of its own, where units start, and units per text."""
    joined = "".join(SPACE + t.replace(SPACE, LITERAL) for t in texts if t)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points[points == 32] = ord(SPACE)
    text_starts = np.cumsum([0, *(len(t) + 1 for t in texts if t)])
    space, line = points == ord(SPACE), points == 10
    begins = line.copy()
    begins[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    begins[text_starts[:-1]] = True
    per_text = np.zeros(len(texts), np.int64)
    if len(points):
        per_text[[i for i, t in enumerate(texts) if t]] = np.add.reduceat(begins.astype(np.int64), text_starts[:-1])
    return points, np.flatnonzero(begins), per_text


def encode_batch(
    p: Pieces, texts: list[str], salts: list[int], seed: int, dropout: float, cache: Segments | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of every text as a flat array with starts; a salt per text goes into its units' draws.

    The ids are those of merging every occurrence under its own key. An occurrence that skips no step
    of its unit's merges without dropout shares their result; one that skips a step goes on from
    there, with all that skipped the same steps, until it skips no more.
    """
    cache = Segments() if cache is None else cache
    points, first, per_text = _units(texts)
    sizes = np.diff(np.append(first, len(points)))
    units = _unit_hashes(points, first, sizes)
    own = _occurrence_keys(units, salts, per_text, seed) if dropout > 0 else units
    alone = (sizes > LONG_UNIT) & (dropout > 0)
    counts = np.zeros(len(first), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if alone.any():
        who = np.flatnonzero(alone)
        flat, counts[who] = segment(p, points, first[who], sizes[who], own[who], dropout)
        found.append((who, flat))
    who = np.flatnonzero(~alone)
    node, skips = units[who], np.zeros((len(who), 0), np.int16)
    while len(who):
        key, inverse = np.unique(node, return_inverse=True)
        some = np.empty(len(key), np.int64)
        some[inverse] = np.arange(len(node))
        at = cache.need(p, points, first[who[some]], sizes[who[some]], key, skips[some])[inverse]
        if dropout > 0:
            skip = cache.first_skip(at, own[who], skips[:, -1].astype(np.int64) + 1 if skips.shape[1] else np.zeros(len(who), np.int64), dropout)
        else:
            skip = np.full(len(who), -1, np.int16)
        ended, more = skip < 0, skip >= 0
        counts[who[ended]] = cache.count[at[ended]]
        found.append((who[ended], cache.flat[_ragged(cache.start[at[ended]], cache.count[at[ended]])]))
        node = _mix(node[more] ^ _mix(skip[more].astype(_U) + _U(0x8BB84B93962EACC9)))
        skips = np.concatenate([skips[more], skip[more, None]], axis=1)
        who = who[more]
    starts = np.cumsum(counts) - counts
    ids = np.empty(int(counts.sum()), np.int32)
    for who, flat in found:
        ids[_ragged(starts[who], counts[who])] = flat
    ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per_text)])]
    return ids, ends


def decode_batch(p: Pieces, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The texts, in UTF-8, of piece ids as a flat array with starts."""
    counts = np.diff(p.raw_start)[ids]
    raw = p.raw[_ragged(p.raw_start[:-1][ids], counts)].tobytes()
    bounds = np.concatenate([[0], np.cumsum(counts)])[starts].tolist()
    # The first byte of a text that has pieces is the space that encoding puts before it.
    return [raw[a + 1 : b] for a, b in zip(bounds, bounds[1:])]


def encode_documents(
    docs: DataFrame, keep: list[Column], model: str = MODEL, seed: int = 17, dropout: float = 0.1
) -> DataFrame:
    """``keep``, ids, n_tokens, decoded_sha256, lossless for every row of ``docs`` (doc_id, text).

    Segmentations depend on seed, doc_id and text: rows that repeat get equal ids. A null text is
    empty and has no ids; a null doc_id is salted like 0. The model is read by the driver and sent
    with the tasks (about half a megabyte). A kept column named like a result gives way to it. Empty
    tables give no rows.
    """
    with open(model, "rb") as f:
        proto = f.read()
    text = docs.select(F.struct(*keep).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_salt"), F.coalesce("text", F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, cache = load(proto), Segments()
        for batch in batches:
            for part in _parts(batch):
                texts = part.column("_text").to_pylist()
                ids, starts = encode_batch(p, texts, part.column("_salt").to_pylist(), seed, dropout, cache)
                back = decode_batch(p, ids, starts)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_row"), lists, pa.array(np.diff(starts)),
                        pa.array([hashlib.sha256(b).hexdigest() for b in back]), pa.array([b == t.encode() for b, t in zip(back, texts)]),
                    ],
                    names=["_row", "ids", "n_tokens", "decoded_sha256", "lossless"],
                )

    row = text.schema["_row"].dataType.simpleString()
    names = ("ids", "n_tokens", "decoded_sha256", "lossless")
    return unpacked(text.mapInArrow(run, f"_row {row}, ids array<int>, n_tokens bigint, decoded_sha256 string, lossless boolean"), *names, names=names)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with about BATCH_CHARS of text, or one longer row."""
    sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column("_text")).to_pylist()])
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_CHARS, side="right")))
        yield batch.slice(at, n)
        at += n


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), [F.col("doc_id").cast("long").alias("doc_id")])
