"""Operator 7: SentencePiece encoding by Gumbel top-k without replacement, and decoding.

A text's lattice has an edge for every vocabulary piece that matches at a place; a segmentation's chance is the product of its pieces' weights (``log_weights``: Zipf's law over the
merge ranks, as the model has no unigram scores), normalised over all segmentations. A perturbed A-star search (top-down, Kool et al., 2019) gives the k segmentations with the greatest Gumbel-perturbed log-chance: each node of the search tree has
the greatest perturbed value of the segmentations below it, the popped node is followed along its best children to a leaf, and at each step the siblings left behind become one node, whose value is a Gumbel
variable truncated at the popped value. Popped values fall, so the leaves are exact draws without replacement. The inclusion score is log(1 - exp(-exp(log-chance - kappa))), kappa being the (k+1)th value.

No piece has a space mark behind another character, so a text falls into independent pieces at its spaces and the lattice is made once for each distinct one, which a task keeps over its slices (``Strings``). Draws are counters hashed with the row's key, so they don't depend on
partitions. Edge cases: a null text counts as empty; an empty text has one segmentation without ids; where fewer than k segmentations exist, all come, with score 0; characters outside the vocabulary become bytes; a literal space
mark is read back as a space, as the library does; rows with equal key and text get equal samples, null doc_ids among them; ties of perturbed values go to the first place; a very long text is one slice of its own, and a string without spaces has one lattice whatever its length;
an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.llm._common import table, text_slices

MARK = "▁"
#: Characters that are segmented at once, and edges (24 bytes each) that a task keeps.
SLICE_CHARS = 150_000
CACHE_EDGES = 1_500_000
#: Bits of a hash by which tables are asked first.
BITS = 18
LAST = np.uint64((1 << BITS) - 1)
SAMPLES = 2
SCHEMA = "doc_id long, samples array<struct<ids: array<int>, log_inclusion: double, text_ok: boolean>>"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of counters."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform_key(key: np.ndarray, *counters: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        for k, c in enumerate(counters):
            key = mix(key + np.asarray(c, dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return key


def uniform(key: np.ndarray, *counters: np.ndarray | int) -> np.ndarray:
    """Numbers above 0 and below 1."""
    return ((uniform_key(key, *counters) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def uniform_one(key: int, *counters: int) -> float:
    """``uniform`` of one key."""
    most = (1 << 64) - 1
    for k, c in enumerate(counters):
        x = (int(key) + (int(c) & most) * 0x9E3779B97F4A7C15 + k + 1) & most
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & most
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & most
        key = x ^ (x >> 31)
    return ((key >> 11) + 0.5) / 2.0**53


def below(location, bound, u):
    """A Gumbel variable at ``location``, truncated at ``bound``."""
    return location - np.log(np.exp(np.minimum(location - bound, 700)) - np.log(u))


class Lattice:
    """The pieces of a model, and the lattices of distinct strings."""

    def __init__(self, model_path: str, smoothness: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        ranks = {i: -sp.get_score(i) if sp.get_score(i) > -1e8 else n for i in normal}
        self.weight = np.full(n + 1, -np.inf)
        for i in normal:
            self.weight[i] = -smoothness * np.log(ranks[i] + 2)
        self.byte_ids, self.byte_weight = np.array([byte[b] for b in range(256)]), -smoothness * np.log(256 * (n + 2))
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        assert not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.longest = max(len(self.pieces[i]) for i in normal)
        self.by_length = {}
        #: By length, a bit for each hash (its last ``BITS`` bits) of the first characters of a longer piece.
        self.longer = {size: np.zeros(1 << BITS, bool) for size in range(1, self.longest + 1)}
        for size in range(1, self.longest + 1):
            own = [i for i in normal if len(self.pieces[i]) == size]
            if own:
                codes = np.frombuffer("".join(self.pieces[i] for i in own).encode("utf-32-le"), np.uint32).reshape(-1, size)
                h = np.zeros(len(own), np.uint64)
                for k in range(size):
                    if k:
                        self.longer[k][h & LAST] = True
                    h = self._more(h, codes[:, k])
                order = np.argsort(h)
                there = np.zeros(1 << BITS, bool)
                there[h & LAST] = True
                self.by_length[size] = h[order], np.array(own)[order], there
        self.single = re.compile(r"(?<=[^ ]) ")
        self.raw_array = pa.array(self.raw, pa.large_binary())

    def with_bytes(self, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in which each -2 - code point has become its bytes' ids, and the cuts between texts moved along."""
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, cut
        known = {i: self.byte_ids[list(chr(-2 - i).encode("utf-8", "surrogatepass"))] for i in set(ids[bare].tolist())}
        own = [known[i] for i in ids[bare].tolist()]
        size = np.ones(len(ids), np.int64)
        size[bare] = [len(x) for x in own]
        out, at = np.repeat(ids, size), np.cumsum(size) - size
        out[np.repeat(at[bare], size[bare]) + np.concatenate([np.arange(len(x)) for x in own])] = np.concatenate(own)
        return out, np.concatenate([at, [len(out)]])[cut]

    @staticmethod
    def _more(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)
            return h ^ (h >> np.uint64(29))

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """How many strings each text has, which these are, and the distinct ones. Each stands for itself with a space mark in front."""
        whole = pa.array(texts, pa.large_string())
        found = pc.split_pattern(whole, " ")
        sizes, flat = np.diff(found.offsets.to_numpy()), found.values
        odd = pc.or_(pc.or_(pc.equal(whole, ""), pc.starts_with(whole, " ")), pc.match_substring(whole, "  ")).to_numpy(zero_copy_only=False).nonzero()[0].tolist()
        at, cuts, chunks = found.offsets.to_numpy(), 0, []
        for k in odd:
            own = self.single.split(texts[k]) if texts[k] else []
            chunks += [flat[cuts : at[k]], pa.array(own, pa.large_string())]
            cuts, sizes[k] = at[k + 1], len(own)
        coded = (pa.concat_arrays([*chunks, flat[cuts:]]) if odd else flat).dictionary_encode()
        return sizes, coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()

    def build(self, words: list[str]) -> dict:
        """Slots (a place in a string, or its end) and their edges, those of a slot side by side by length: next slot, id, log-chance, and the chances summed up over all edges."""
        marked = [MARK + w.replace(" ", MARK) for w in words]
        size = np.array([len(w) for w in marked], dtype=np.int64)
        first = np.cumsum(size + 1) - size - 1
        n = int((size + 1).sum())
        left = np.repeat(first + size, size + 1) - np.arange(n)  # characters up to the string's end
        inner = left > 0
        codes = np.zeros(n + self.longest, np.uint32)
        codes[:n][inner] = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        rows, found = np.flatnonzero(inner).astype(np.int32), []
        h, bare = np.zeros(len(rows), np.uint64), inner.copy()
        for k in range(1, self.longest + 1):
            h = self._more(h, codes[rows + (k - 1)])
            low = (h & LAST).astype(np.int32)
            if k in self.by_length:
                known, ids, there = self.by_length[k]
                maybe = np.flatnonzero(there[low])
                at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
                hit = known[at] == h[maybe]
                own, at = rows[maybe[hit]], ids[at[hit]]
                found.append((own, k, at, self.weight[at]))
                if k == 1:
                    bare[own] = False
            on = np.flatnonzero(self.longer[k][low])
            on = on[left[rows[on]] > k]
            if not len(on):
                break
            rows, h = rows[on], h[on]
        bare = np.flatnonzero(bare).astype(np.int32)
        code = codes[bare].astype(np.int64)
        found.append((bare, 1, -2 - code, self.byte_weight * (1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))))  # bytes
        degree = np.zeros(n, np.int32)
        for own, *_ in found:
            degree[own] += 1
        order = np.argsort(left.astype(np.uint16) if n < 1 << 16 or left.max() < 1 << 16 else left, kind="stable")  # slots by their distance to the end
        begin = np.empty(n, np.int32)
        begin[order] = np.cumsum(degree[order]) - degree[order]
        edges = int(degree.sum())
        after, ids, score, free = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges), begin.copy()
        for own, k, of, weight in sorted(found, key=lambda f: -f[1]):  # the longest first, as it is mostly the likeliest
            to = free[own]
            after[to], ids[to], score[to] = own + k, of, weight
            free[own] += 1
        total = np.zeros(n)
        logp = np.empty(edges)
        bounds = np.cumsum(np.bincount(left))
        for d in range(1, len(bounds)):
            own = order[bounds[d - 1] : bounds[d]]
            if not len(own):
                continue
            a, z = begin[own[0]], begin[own[-1]] + degree[own[-1]]
            x, at = score[a:z] + total[after[a:z]], begin[own] - a
            top = np.maximum.reduceat(x, at)
            value = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, degree[own])), at))
            total[own] = value
            logp[a:z] = x - np.repeat(value, degree[own])
        return {"next": after, "id": ids, "logp": logp, "begin": begin, "degree": degree, "end": ~inner, "first": first}


class Strings:
    """The lattices of the strings that a task has met, kept over its slices.

    Edges of a place lie side by side. An edge holds the place where the next one begins (its first edge, -1 at the string's end), its id and log-chance, and ``upto``: the chances of its place's edges up to it, the last one's without bound.
    Beyond ``CACHE_EDGES`` only strings that came up three times or more are kept, and none if these fill half of that.
    """

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        room = CACHE_EDGES + CACHE_EDGES // 4
        self.next, self.id, self.logp, self.upto = np.empty(room, np.int32), np.empty(room, np.int32), np.empty(room), np.empty(room)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.used = 0
        self.first, self.uses = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _put(self, name: str, values: np.ndarray) -> None:
        own = getattr(self, name)
        if self.used + len(values) > len(own):
            own = np.concatenate([own[: self.used], np.empty(self.used // 4 + len(values), own.dtype)])
            setattr(self, name, own)
        own[self.used : self.used + len(values)] = values

    def learn(self, words: list[str]) -> None:
        lat = self.lattice.build(words)
        begin, base = lat["begin"], self.used
        place = np.where(lat["end"], -1, begin + base).astype(np.int32)
        chance = np.exp(lat["logp"])
        run = np.cumsum(chance)
        inner = np.flatnonzero(~lat["end"])
        inner = inner[np.argsort(begin[inner])]
        start, degree = begin[inner], lat["degree"][inner]
        upto = run - np.repeat(run[start] - chance[start], degree)
        upto[start + degree - 1] = np.inf
        for name, values in (("next", place[lat["next"]]), ("id", lat["id"]), ("logp", lat["logp"]), ("upto", upto)):
            self._put(name, values)
        self.used += len(upto)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.first = np.concatenate([self.first, place[lat["first"]]])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int32)])

    def first_edges(self, words: list[str], index: np.ndarray) -> np.ndarray:
        """The first edge of each string; ``index`` says which of the distinct ``words`` it is."""
        if self.used > CACHE_EDGES:
            often = np.flatnonzero(self.uses >= 3)
            words_now, edges = list(self.known), self.used
            kept = [words_now[k] for k in often.tolist()]
            share = len(often) / max(len(self.known), 1)
            self.clear()
            if kept and share * edges < CACHE_EDGES / 2:
                self.learn(kept)
        found = list(map(self.known.get, words))
        if None in found:
            self.learn([w for w, k in zip(words, found, strict=True) if k is None])
            found = list(map(self.known.__getitem__, words))
        found = np.array(found, dtype=np.int64)
        self.uses[found] += np.bincount(index, minlength=len(words)).astype(np.int32)
        return self.first[found][index]

    def edges_of(self, edge: int) -> slice:
        """All edges of the place that begins with ``edge``."""
        end = edge
        while not np.isinf(self.upto[end]):
            end += 1
        return slice(edge, end + 1)


def others(known: Strings, first: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The chance of a place's edges but for the one taken, as a sum of theirs: one less the other's chance would be lost in rounding where that is nearly one."""
    total, edge, live = np.zeros(len(first)), first.astype(np.int64), np.arange(len(first))
    while len(live):
        e = edge[live]
        total[live] += np.where(e == taken[live], 0.0, np.exp(known.logp[e]))
        live = live[~np.isinf(known.upto[e])]
        edge[live] += 1
    return total


def walk(known: Strings, edge: np.ndarray, key: np.ndarray, place: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From each place (its first edge) down to the string's end by the edges' chances: how many steps each start has, and of each step, in order, the place's first edge and the edge taken."""
    with np.errstate(over="ignore"):
        own = uniform_key(key, place, sample)
    counts = np.zeros(len(edge), np.int32)
    who = np.flatnonzero(edge >= 0).astype(np.int32)
    at, parts = edge[who], []
    upto, following = known.upto, known.next
    while len(who):
        u = uniform(own[who], len(parts))
        taken = at.copy()
        more = np.flatnonzero(u >= upto[taken])
        while len(more):
            taken[more] += 1
            more = more[u[more] >= upto[taken[more]]]
        parts.append((who, at, taken))
        counts[who] += 1
        at = following[taken]
        alive = np.flatnonzero(at >= 0)
        who, at = who[alive], at[alive]
    begin = np.cumsum(counts) - counts
    froms, takens = np.empty(int(counts.sum()), np.int32), np.empty(int(counts.sum()), np.int32)
    for k, (w, a, j) in enumerate(parts):
        to = begin[w] + k
        froms[to], takens[to] = a, j
    return counts, froms, takens


def _runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0] - 1, 0, 1, ..."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def top_k(lattice: Lattice, texts: list[str], keys: np.ndarray, k: int = SAMPLES, known: Strings | None = None) -> list[list[tuple[np.ndarray, float]]]:
    """For each text up to k distinct segmentations (ids, log inclusion score), the most likely by its perturbed value first."""
    known = known or Strings(lattice)
    sizes, index, words = lattice.split(texts)
    first = known.first_edges(words, index) if words else np.zeros(0, np.int32)
    doc_end = np.cumsum(sizes)
    doc_begin = doc_end - sizes
    keys = keys.astype(np.uint64)
    result: list[list] = [[(np.zeros(0, np.int64), 0.0)] if not n else [] for n in sizes]
    live = np.flatnonzero(sizes)
    if not len(live):
        return result
    paths: dict[int, list[dict]] = {d: [] for d in live.tolist()}

    def add(docs: np.ndarray, string: np.ndarray, edge: np.ndarray, before: np.ndarray, kept: list[list], value: np.ndarray, sample: int) -> None:
        """Walks on from each document's string (from the place that begins with ``edge``, if that isn't -1) and files the new path with the values of what it leaves behind."""
        n = doc_end[docs] - string
        which = np.repeat(np.arange(len(docs)), n)
        own = _runs(n) + string[which]
        start = first[own]
        head = (np.cumsum(n) - n)[edge >= 0]
        start[head] = edge[edge >= 0]
        place = own - doc_begin[docs][which]
        counts, froms, taken = walk(known, start, keys[docs][which], place, sample)
        steps = np.concatenate([[0], np.cumsum(counts)])
        cut = steps[np.concatenate([[0], np.cumsum(n)])]
        run = np.concatenate([[0.0], np.cumsum(known.logp[taken])])
        logp = before + run[cut[1:]] - run[cut[:-1]]
        # a value is found for every place whose mass isn't below the first one's by e**-60: a Gumbel variable that much lower never comes up first
        near = np.minimum(np.searchsorted(-run, 60 - run[cut[:-1]], side="right"), cut[1:]) - cut[:-1]
        of = np.repeat(np.arange(len(docs)), near)
        at = cut[:-1][of] + _runs(near)
        ahead = before[of] + run[at] - run[cut[:-1]][of]
        word = np.searchsorted(steps, at, side="right") - 1
        rest = -np.expm1(np.minimum(known.logp[taken[at]], 0))
        low = np.flatnonzero(rest < 1e-9)
        low = low[~np.isinf(known.upto[froms[at[low]]])]  # places of one edge leave nothing behind
        rest[low] = others(known, froms[at[low]], taken[at[low]])
        left = np.where(rest > 0, ahead + np.log(np.maximum(rest, 1e-300)), -np.inf)
        bound = np.where(np.isfinite(left), below(left, value[of], uniform(keys[docs][of], place[word], at - steps[word], 1000 + sample)), -np.inf)
        ends = np.concatenate([[0], np.cumsum(near)])
        for x, d in enumerate(docs.tolist()):
            a, z, b, e = cut[x], cut[x + 1], ends[x], ends[x + 1]
            paths[d].append({"kept": kept[x], "edge": taken[a:z], "from": froms[a : a + near[x]], "place": place[word[b:e]], "ahead": ahead[b:e], "bound": bound[b:e], "logp": logp[x], "taken": {}})

    root = -np.log(-np.log(uniform(keys[live], 7, 7)))
    add(live, doc_begin[live], np.full(len(live), -1), np.zeros(len(live)), [[]] * len(live), root, 0)
    kappa = dict.fromkeys(paths, -np.inf)
    for sample in range(1, k + 1):
        todo: list[tuple] = []
        for d, own in paths.items():
            if len(own) < sample:
                continue
            tops = [p["bound"].max() if len(p["bound"]) else -np.inf for p in own]
            which = int(np.argmax(tops))
            if not np.isfinite(tops[which]):
                continue
            if sample == k:
                kappa[d] = tops[which]
                continue
            p = own[which]
            t = int(np.argmax(p["bound"]))
            taken = p["taken"].setdefault(t, {int(p["edge"][t])})
            place, at = int(p["place"][t]), known.edges_of(int(p["from"][t]))
            chance = np.exp(known.logp[at])
            chance[[j - at.start for j in taken]] = 0
            total = chance.sum()
            u = uniform_one(keys[d], place, t, 2000 + sample)
            j = int(min(np.searchsorted(np.cumsum(chance), u * total, side="right"), np.flatnonzero(chance)[-1]))
            chance[j] = 0
            after = chance.sum()
            j += at.start
            taken.add(j)
            p["bound"][t] = below(p["ahead"][t] + np.log(after), tops[which], uniform_one(keys[d], place, t, 3000 + sample)) if after > 0 else -np.inf
            onward = int(known.next[j])
            todo.append((d, doc_begin[d] + place + (onward < 0), onward, p["ahead"][t] + known.logp[j], [*p["kept"], p["edge"][:t], np.array([j], np.int32)], tops[which]))
        if todo:
            d, string, edge, before, kept, value = zip(*todo, strict=True)
            add(np.array(d), np.array(string), np.array(edge), np.array(before), list(kept), np.array(value), sample)
    flat = [(d, p) for d, own in paths.items() for p in own[:k]]
    chunks = [x for _, p in flat for x in (*p["kept"], p["edge"])]
    ids = known.id[np.concatenate(chunks)].astype(np.int64)
    cut = np.concatenate([[0], np.cumsum([sum(map(len, p["kept"])) + len(p["edge"]) for _, p in flat])])
    ids, cut = lattice.with_bytes(ids, cut)
    for (d, p), a, z in zip(flat, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        gap = p["logp"] - kappa[d]
        result[d].append((ids[a:z], 0.0 if np.isinf(kappa[d]) else float(np.log(-np.expm1(-np.exp(gap)))) if gap > -30 else float(gap)))
    return result


def decode(lattice: Lattice, ids: np.ndarray) -> str:
    return b"".join(map(lattice.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def decoded_alike(lattice: Lattice, ids: np.ndarray, cut: np.ndarray, texts: list[str]) -> list[bool]:
    """Whether each run of ids is decoded to its text: all pieces' bytes side by side, compared text by text."""
    found = lattice.raw_array.take(pa.array(ids))
    raw, at = memoryview(found.buffers()[2] or b"").cast("B"), found.buffers()[1]
    at = np.frombuffer(at, np.int64)[: len(ids) + 1][cut].tolist()
    return [raw[a + 1 : z] == t.replace(MARK, " ").encode() for a, z, t in zip(at[:-1], at[1:], texts, strict=True)]


#: A worker's models; its strings go with each task, so that an idle worker holds no more than a model.
_MODELS: dict[str, Lattice] = {}


def model_of(model_path: str) -> Lattice:
    if model_path not in _MODELS:
        _MODELS[model_path] = Lattice(model_path)
    return _MODELS[model_path]


def sample(docs: DataFrame, model_path: str, k: int = SAMPLES) -> DataFrame:
    """(doc_id, samples): up to k segmentations of each whole text, with whether their decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = model_of(model_path)
        known = Strings(lattice)
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, raw in text_slices(batch.column(2), SLICE_CHARS):
                texts = [t or "" for t in raw]
                got = top_k(lattice, texts, keys[a:b], k, known)
                flat = [x for own in got for x in own]
                all_ids, cut = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in flat)]), np.concatenate([[0], np.cumsum([len(x[0]) for x in flat])]).astype(np.int64)
                ok = decoded_alike(lattice, all_ids, cut, [t for own, t in zip(got, texts, strict=True) for _ in own])
                ids = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(all_ids, pa.int32()))
                structs = pa.StructArray.from_arrays([ids, pa.array([x[1] for x in flat], pa.float64()), pa.array(ok, pa.bool_())], names=["ids", "log_inclusion", "text_ok"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(own) for own in got])]), pa.int32()), structs)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], names=["doc_id", "samples"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long")).alias("key"), "text").mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    each = lambda f: F.transform("samples", f)
    return found.select(
        "doc_id",
        F.size("samples").alias("n_samples"),
        F.array_join(each(lambda s: F.size(s["ids"])), ",").alias("n_tokens"),
        F.array_join(each(lambda s: F.hex(F.xxhash64(s["ids"]))), ",").alias("ids_hash"),
        F.array_join(each(lambda s: F.format_string("%.6f", s["log_inclusion"])), ",").alias("log_inclusion"),
        F.forall("samples", lambda s: s["text_ok"]).alias("decoded"),
    )


def op7_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(sample(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))
