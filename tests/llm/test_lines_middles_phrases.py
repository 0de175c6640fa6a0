"""Operators 11 to 13 against brute force and against their SQL, and on nulls, empty texts, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, hi long, key long, phrase string"


def docs(spark, texts, start=0, langs=("en",)):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(start + k, t, langs[k % len(langs)], "s", len(t or ""), "r", 1, 2, "p") for k, t in enumerate(texts)], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(2)
    many = " ".join(rnd.choice(["alpha", "beta", "Gamma", "ñandú", "€", "x"]) + rnd.choice(["", ".", "\n", "  "]) for _ in range(60_000))
    return [None, "", " ", "a", "\n", "\n\n", "ñandú €😀 \x1c x", "x" * 200_000, "é" * 100_001, many, many, "a <P> b", "a<<P", "<S", "AB<\nCD", "\x00\x01 b", " \t\x0b\x0c\r ", "tab\tand  space"]


def fim(text, doc_id):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("frame", [1 << 16, 7])
def test_middles_equal_brute_force(spark, odd, tmp_path, frame):
    """With small frames too, whose edges cut words and would cut code points."""
    from pricelore.llm import middle_fill as m

    texts = odd if frame > 100 else [t for t in odd if len(t or "") < 1000] + ["abc def ghi " * 9, "éàü€😀 abc" * 7] * 12
    both = docs(spark, texts).unionByName(docs(spark, ["Without an id"]).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs(spark, ["again and again"] * 3).withColumn("doc_id", F.lit(77_777).cast("long")))
    m.write_frames(both, f"{tmp_path}/frames", frame)
    stored = m.read_frames(spark, f"{tmp_path}/frames")
    got = {r["doc_id"]: r for r in m.digests(stored).collect()}
    texts_of = {r["doc_id"]: r for r in m.outputs(stored).collect()}
    for doc_id, text in [*enumerate(texts), (None, "Without an id"), (77_777, "again and again")]:
        n, form, p, mid, out = fim(text, doc_id)
        r = got[doc_id]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, mid), doc_id
        assert (r["output_sha256"], r["restored_sha256"]) == (sha(out), sha(text or ""))
        assert (texts_of[doc_id]["form"], texts_of[doc_id]["output"]) == (form, out)
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"} and m.digests(stored).where("doc_id = 77777").count() == 3
    m.write_frames(docs(spark, []), f"{tmp_path}/none")
    assert m.digests(m.read_frames(spark, f"{tmp_path}/none")).count() == 0


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_marks_cut_by_the_edges_of_a_stream(form):
    from pricelore.llm import middle_fill as m

    parts = {"<P>": "one <S two <", "<S>": "<<P <M end", "<M>": ""}
    out = "".join(mark + parts[mark] for mark in (("<P>", "<S>", "<M>") if form == "psm" else ("<S>", "<P>", "<M>"))).encode()
    for size in range(1, 12):
        stream = [out[k : k + size] for k in range(0, len(out), size)]
        assert b"".join(m.restored(stream, form)).decode() == parts["<P>"] + parts["<M>"] + parts["<S>"]


def shared_lines(rows):
    """(doc_id, text) to (lines, dropped, kept text), one key at a time."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(fold)
    held = defaultdict(set)
    for k, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            held[key(line)].add(k)
    low = lambda x: -(2**63) if x is None else x
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or low(doc_id) == max(low(rows[k][0]) for k in held[key(x)])]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("way", ["broadcast", "dealt"])
def test_lines_equal_brute_force(spark, odd, monkeypatch, way):
    from pricelore.llm import line_dedup as m

    rnd, texts = random.Random(7), list(odd)
    common = [f"A line that is shared by some documents, number {k}" for k in range(40)] + ["ÉÀÜÉÀÜÉÀÜÉÀÜÉÀÜÉÀÜÉÀÜ", "nineteen characters", "twenty characters ok"]
    for k in range(150):
        lines = ["Accept all cookies to go on reading this page"] if k % 3 else []
        lines += [rnd.choice(common) for _ in range(rnd.randint(0, 6))] + [f"only here {k}" * 3] * rnd.randint(0, 2)
        rnd.shuffle(lines)
        texts.append("\n".join(rnd.choice(["", " ", "\t"]) + (x.upper() if rnd.random() < 0.2 and x.isascii() else x) + rnd.choice(["", "\r", "  "]) for x in lines))
    frame = docs(spark, texts).unionByName(docs(spark, [common[0] + "\nmine"] * 2).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs(spark, [common[1], common[1] + "\n" + common[1]]).withColumn("doc_id", F.lit(9_999).cast("long")))
    frame = frame.unionByName(docs(spark, ["Held by documents without an id only"] * 4).withColumn("doc_id", F.lit(None).cast("long")))
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    bound = m.BROADCAST_BYTES
    if way == "dealt":
        monkeypatch.setattr(m, "SHARD_KEYS", 7)
        monkeypatch.setattr(m, "PIECE", 20)
        bound = 0
    want = shared_lines(rows)
    got = m.report(frame, broadcast_bytes=bound).collect()
    order = lambda rows: Counter(map(tuple, rows))
    assert order(got) == order([(d, n, gone, sha(kept)) for d, n, gone, kept in want]) and sum(x[2] for x in want) > 100
    cleaned = m.without_shared_lines(frame, broadcast_bytes=bound)
    assert cleaned.columns == frame.columns
    texts_of = order((r["doc_id"], r["text"], r["n_chars"]) for r in cleaned.select("doc_id", "text", "n_chars").collect())
    assert texts_of == order((d, None if t is None else kept, None if t is None else len(kept)) for (d, _, _, kept), (_, t) in zip(want, rows, strict=True))
    assert m.report(docs(spark, []), broadcast_bytes=bound).count() == 0


def test_perfect_hash_is_minimal():
    from pricelore.llm import line_dedup as m

    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 1000, 20_000):
        hi, lo = rnd.integers(-(2**63), 2**63, size=(2, n))
        levels, sizes = m.build(hi, lo)
        shard = m.Shard([x.tobytes() for x in levels], sizes, lo, np.arange(n), np.arange(n))
        at = shard.find(hi, lo)
        assert sorted(at.tolist()) == list(range(n)) and sum(sizes) <= 6 * n + 64 * max(1, len(sizes))
        order = np.argsort(at)
        shard = m.Shard([x.tobytes() for x in levels], sizes, lo[order], order + 3, order)
        assert (shard.probe(hi, lo)[0] == np.arange(n) + 3).all()
        other = rnd.integers(-(2**63), 2**63, size=(2, 500))
        assert not shard.probe(*other)[0].any()


def best_phrases(rows, least=100, top=2000):
    """Everything counted one by one."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 6):
                f.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {x: a for x, a in f.items() if len(x) > 2 and a >= least}
    rows = defaultdict(list)
    for (lang, *w), a in found.items():
        score, k, left, right = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        rows[lang].append((-score, -a, " ".join(w).encode(), left, right, w, k))
    longest = defaultdict(int)
    for (lang, *w), a in found.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    longest[(lang, *w[i:j])] = max(longest[(lang, *w[i:j])], a)
    out = []
    for lang, own in rows.items():
        own = sorted(x for x in own if longest[(lang, *x[5])] < -x[1])
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right, _, _) in enumerate(own[:top], 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_phrases_equal_brute_force(spark, odd, monkeypatch, small):
    """With buckets that hold much at once, tiny blocks, shards and broadcasts, too."""
    from pricelore.llm import collocations as m

    rnd = random.Random(19)
    if small:
        for name, value in {"BLOCK_WORDS": 300, "SLICE_BYTES": 500, "TASK_WORDS": 40, "SHARD_PHRASES": 10, "BROADCAST_BYTES": 2000, "MIN_BUCKETS": m.CHUNK, "MAX_BUCKETS": m.CHUNK}.items():
            monkeypatch.setattr(m, name, value)
    vocabulary = [f"w{k}" for k in range(30)] + ["New", "YORK", "ñandú", "a\x00b", "q", "€"]
    texts = []
    for _ in range(900):
        t = []
        while len(t) < rnd.randint(5, 60):
            t += rnd.choice([["new", "york", "city"], ["of", "the"], ["go", "go", "go", "go"], ["one", "two", "three", "four", "five", "six"]]) if rnd.random() < 0.3 else [rnd.choice(vocabulary)]
            if rnd.random() < 0.1:
                t[-1] += rnd.choice(".,;:!?\n\r")
        texts.append(rnd.choice([" ", "  ", "\t"]).join(t))
    frame = docs(spark, [*odd, *texts], langs=("en", None, "de")).repartition(3)
    want = best_phrases([(r["lang"], r["text"]) for r in frame.collect()])
    got = [tuple(r) for r in m.collocations(frame).collect()]
    assert sorted(got) == sorted(want) and len(want) > 30 and {x[0] for x in want} == {"en", "und", "de"} and max(len(x[2].split()) for x in want) == 5
    if small:
        few = [tuple(r) for r in m.collocations(frame, top=3).collect()]
        assert sorted(few) == sorted(x for x in want if x[1] <= 3)
        assert m.collocations(docs(spark, [])).count() == 0 and m.collocations(docs(spark, [None, "", "one"])).count() == 0


def test_counting_tasks_hold_no_table_of_buckets():
    """A task's memory follows the positions that it works on; a count for each of 2^28 buckets would be a gigabyte in every task."""
    import tracemalloc
    from types import SimpleNamespace

    from pricelore.llm import collocations as m

    held = []

    def keep(f, schema):
        held.append(f)
        raise StopIteration

    context = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value, destroy=lambda: None))
    with pytest.raises(StopIteration):
        m.full_buckets(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), mapInArrow=keep), 2, {}, 1 << 28, 100)
    x = np.random.default_rng(1).integers(0, 1000, 100_000).astype("<i4")
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in held[0](iter([pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["ids"])])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows and peak < 50e6


@pytest.mark.parametrize("least", [4, 60])
def test_candidates_of_many_parts(spark, monkeypatch, least):
    """Parts that tell all (least 4: a share of one at most, so the candidates are what is frequent) and parts that keep small counts to themselves; all phrases begin with few words."""
    from pricelore.llm import collocations as m

    for name, value in {"POSITIONS": 400, "BLOCK_WORDS": 300, "PIECES": 8, "SHARD_PHRASES": 30}.items():
        monkeypatch.setattr(m, name, value)
    rnd = np.random.default_rng(4)
    rows = [rnd.choice([0, 1, 1, 1, 2, 3, 4, 5, 6], 300).astype("<i4") for _ in range(40)]
    ids = spark.createDataFrame([(bytearray(x.tobytes()),) for x in rows], "ids binary").repartition(3)
    words, counts = sum(int(np.count_nonzero(x)) for x in rows), Counter()
    for x in rows:
        for k in range(1, 6):
            counts.update(tuple(p) for p in np.lib.stride_tricks.sliding_window_view(x, k).tolist() if 0 not in p)
    frequent = {p for p, a in counts.items() if len(p) > 1 and a >= least}
    full = {}
    for k in m.HASHED:
        full[k] = m.full_buckets(ids, k, full, 1 << 16, least)
        assert {p for p in counts if len(p) == k and full[k][(b := int(m._hash(np.array(p), np.array([0]), k, 1 << 16)[0])) >> 3] >> (b & 7) & 1} >= {p for p in frequent if len(p) == k}
    found = m.cut(m.candidates(m.told(ids, full, 1 << 16, least, words), least))
    got = [tuple(p) for r in found.collect() for p in np.array(r["phrases"]).reshape(-1, r["k"]).tolist()]
    assert len(got) == len(set(got)) and set(got) >= frequent and {p[:-1] for p in got if len(p) > 2} <= set(got)
    assert least > 4 or set(got) == frequent
    assert m.tries(found).count() > 1
    assert {tuple(r["phrase"]): r["a"] for r in m.phrase_counts(ids, found, least).collect()} == {p: counts[p] for p in frequent}


def test_trie_walks_as_a_dictionary_does():
    from pricelore.llm import collocations as m

    rnd = random.Random(5)
    known = set()
    for _ in range(900):
        p = [rnd.randint(1, 40) for _ in range(rnd.randint(2, 5))]
        known |= {tuple(p[:k]) for k in range(2, len(p) + 1)}
    rows = np.array(sorted(p + (0,) * (5 - len(p)) for p in known), np.int32)
    base, check, state = m.trie(rows)
    assert len(set(state.tolist())) == len(rows) and len(base) == len(check)
    text = np.array([rnd.randint(0, 45) for _ in range(20_000)], np.int32)
    counts, plain = m.advance(text, base, check), Counter()
    for k in range(2, 6):
        plain.update(tuple(text[i : i + k].tolist()) for i in range(len(text) - k + 1))
    assert [counts[s] for s in state] == [plain[tuple(x for x in r if x)] for r in rows.tolist()] and counts.sum() == sum(plain[p] for p in known)


@pytest.mark.parametrize("name", ["op11_framed_middle", "op12_hashed_lines", "op13_phrase_tries"])
def test_queries_equal_their_sql(spark, tmp_path, name):
    import duckdb

    from pricelore.llm import registry

    rnd = random.Random(23)
    texts = [None, "", "A shared line of some length here\nmine"] + ["a shared line of some length here\n" + " ".join(rnd.choice(["big", "red", "cat", "ÉTÉ", "dog."]) for _ in range(30)) for _ in range(400)]
    docs(spark, texts, langs=("en", None)).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path)).toArrow()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    rows = lambda t: Counter(tuple(str(r[c]) for c in sorted(t.column_names)) for r in t.to_pylist())
    assert rows(got) == rows(want) and got.num_rows > 0 and pa.types.is_int64(got.schema.field(0).type) == (name != "op13_phrase_tries")
