import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from docgraph.llm import decontaminate, graph, paragraphs, passages, queries, simhash, substrings


def removed_by_brute_force(rows, width):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for p in range(len(t) - width + 1):
            first.setdefault(t[p : p + width], i)
    out = Counter()
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if first[t[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        out[i, bytes(b for b, x in zip(t, gone) if not x)] += 1
    return out


def some_texts(seed=5, n=120):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(60)]
    shared = [" ".join(r.choice(words) for _ in range(r.randint(5, 30))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))), r.choice(shared + [""]), "ab " * r.randint(0, 60)]
        r.shuffle(parts)
        out.append((r.randint(0, n), " ".join(parts)[: r.randint(1, 600)]))
    return out


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 2000}, {"block_bytes": 2000, "hot": 1}, {"block_bytes": 900, "hot": 4, "width": 33}])
def test_substrings_equal_brute_force(make, settings):
    rows = some_texts()
    got = Counter((r.doc_id, bytes(r.kept)) for r in substrings.dedup_substrings(make(rows), **settings).collect())
    assert got == removed_by_brute_force([(i, t.encode()) for i, t in rows], settings.get("width", 50))


def test_longest_previous_factors():
    r = np.random.default_rng(3)
    for trial in range(30):
        n, width = int(r.integers(1, 60)), 6
        rows = r.integers(1, 3, (n, width)).astype(np.uint8)
        doc, group = r.integers(0, 9, n), r.integers(0, 3, n).astype(np.uint64)
        order, factor = substrings.longest_previous(rows, doc, group)
        common = lambda a, b: next((k for k in range(width) if rows[a][k] != rows[b][k]), width)
        want = [max((common(i, j) for j in range(n) if group[i] == group[j] and doc[j] < doc[i]), default=0) for i in order]
        assert factor.tolist() == want
    keys, rows = np.array([5, 5, 6, 5, 6], np.uint64), np.array([[1], [2], [3], [1], [2]], np.uint8)
    first, number = substrings._alike(keys, rows)
    assert [rows[first[i]][0] for i in number] == [1, 2, 3, 1, 2]  # equal hashes do not make equal bytes


def test_substrings_odd(odd, empty):
    got = substrings.dedup_substrings(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.n_removed for r in by[1]] == [0, 0]  # equal doc_ids are not earlier than each other
    assert by[2][0].n_removed == by[2][0].n_bytes and bytes(by[2][0].kept) == b""
    assert by[3][0].n_bytes == by[4][0].n_bytes == 0
    assert by[None][0].n_removed == by[None][0].n_bytes  # a null doc_id comes last
    assert by[9][0].n_removed == 0  # repeats within a document stay
    assert substrings.dedup_substrings(empty).count() == 0
    with pytest.raises(ValueError):
        substrings.dedup_substrings(empty, width=10)


def fingerprint_by_loops(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_fingerprints():
    for t in ("", "one", "One TWO", "a b c d e f g", " a\tb \n c d ", "é É x y " * 40):
        assert simhash.simhash(t.encode()) == fingerprint_by_loops(t)


def test_simhash_links_equal_brute_force(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    values = {b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(12)}
    core = base[0]  # a crowded bucket: many values that share a half
    values |= {core ^ (1 << i) ^ (1 << j) for i in range(32) for j in range(0, 32, 3)}
    f = np.array(sorted(values), np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    label = np.arange(len(f))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(f))])
        if (new == label).all():
            break
        label = new
    fps = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    for most in (2, 48, 10**6):
        edges = simhash.links(fps, most)
        assert edges.where("bit_count(a ^ b) not in (1, 2)").count() == 0
        root = {x.node: x.root for x in graph.components(edges).collect()}
        groups = defaultdict(set)
        for i, x in enumerate(f.view(np.int64).tolist()):
            groups[root.get(x, x)].add(i)
        want = defaultdict(set)
        for i, l in enumerate(label):
            want[l].add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_odd(odd, empty, make):
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    by = {i: (f, c) for i, f, c in got}
    assert by[1] == by[2] and by[2][1] == 1 and by[None][1] == 1
    assert by[3] == by[4] == by[5] == by[11] == (0, 3)
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id in (1, 2, 3, 4)) == [1, 1, 3]


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_few_rounds(spark):
    """A hub of many, a long chain, a node of many hubs and repeats over many tasks settle in few rounds, each of few shuffles (F1)."""
    r = random.Random(4)
    pairs = [(5, 10_000 + i) for i in range(3000)] + [(9_000_000, 20_000 + i) for i in range(500)] + [(30_000 + i, 30_001 + i) for i in range(600)] + [(7, 8)] * 400 + [(10_001, 20_001)]
    r.shuffle(pairs)
    pairs = [p if r.random() < 0.5 else p[::-1] for p in pairs]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(13)
    want = {x: 5 for x in [5, 9_000_000, *range(10_000, 13_000), *range(20_000, 20_500)]} | {30_000 + i: 30_000 for i in range(601)} | {7: 7, 8: 7}
    for most in (1 << 20, 16):
        got = graph.pointers(edges, 12, most).collect()
        assert len(got) == len({x.node for x in got})
        assert {x.node: x.root for x in got} == {x: y for x, y in want.items() if x != y}
    assert {x.node: x.root for x in graph.components(edges, 6).collect()} == want
    u, v = np.array([4, 3, 9, 9]), np.array([3, 2, 8, 8])
    assert graph._star(u, v, np.zeros(4, bool)).to_pydict() == {"u": [3, 4, 9], "v": [2, 2, 8], "moved": [True] * 3}
    assert graph._star(u[2:], v[2:], np.zeros(2, bool)).to_pydict() == {"u": [9], "v": [8], "moved": [False]}


def test_paragraphs_equal_brute_force(make):
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    lines = [[r.choice(words) for _ in range(r.randint(15, 70))] for _ in range(12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(r.randint(0, 5)):
            line = list(r.choice(lines)) if r.random() < 0.7 else [r.choice(words) for _ in range(30)]
            for _ in range(r.randint(0, 2)):
                line[r.randrange(len(line))] = r.choice(words)
            text.append(" ".join(line))
        rows.append((i, "\n".join(text)))
    items = []
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            w = line.split()
            if len(w) >= 20:
                items.append((i, k, {tuple(w[j : j + 5]) for j in range(len(w) - 4)}))
    label = list(range(len(items)))
    changed = True
    while changed:
        changed = False
        for a in range(len(items)):
            for b in range(a):
                s, u = items[a][2], items[b][2]
                if len(s & u) >= 0.8 * len(s | u) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    want = defaultdict(list)
    for a, (i, k, _) in enumerate(items):
        if label[a] != a:
            want[i].append(k)
    for settings in ({}, {"number": 10, "rows": 3}):
        got = {x.doc_id: x.removed for x in paragraphs.dedup_paragraphs(make(rows), **settings).collect()}
        assert got == {i: ",".join(map(str, want.get(i, []))) for i, _ in rows}


def test_paragraphs_in_crowded_buckets_lose_no_link(make):
    """Hundreds of texts that share a passage, so that they meet in a few large buckets, while true links are pairs and chains."""
    r = random.Random(4)
    shared = [f"s{i}" for i in range(30)]
    rows = []
    for i in range(150):
        own = [f"o{i}x{j}" for j in range(25)]
        for k in range(r.choice([1, 1, 2, 3])):
            rows.append((len(rows), " ".join(shared + own)))
            own = own[:-2] + [f"e{i}y{k}y{j}" for j in range(2)]
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                label[a] = min(label[a], label[b])
    want = sum(x != i for i, x in enumerate(label))
    got = paragraphs.dedup_paragraphs(make(rows))
    assert 20 < want == got.agg({"n_removed": "sum"}).first()[0]


def test_paragraphs_odd(odd, empty, make):
    got = {r.doc_id: r for r in paragraphs.dedup_paragraphs(odd).collect()}
    assert set(got) == {r.doc_id for r in odd.collect()}
    assert got[3].n_lines == got[4].n_lines == 0 and got[6].n_lines == 1 and got[6].n_paragraphs == 0
    assert got[2].n_removed == 1 and got[2].class_id == 1 or got[None].n_removed == 0
    assert paragraphs.dedup_paragraphs(empty).count() == 0
    two = make([(1, PARA + "\nshort"), (2, "x\n" + PARA)])
    assert {r.doc_id: r.text for r in paragraphs.remove_repeats(two).collect()} == {1: PARA + "\nshort", 2: "x"}
    with pytest.raises(ValueError):
        paragraphs.repeated(empty, least=3)


def test_short_and_wrapped_paragraphs(spark, make, tmp_path):
    passage = [f"p{i}" for i in range(60)]
    wrap = lambda n: "\n".join(" ".join(passage[i : i + n]) for i in range(0, 60, n))
    texts = ["Read this line again.\nfirst own", wrap(12), "second own line\n\n" + wrap(13) + "\n\nRead this line again.", " ".join(passage), "one\n\none\n" + " ".join(f"o{i}" for i in range(30))]
    make([(i, t) for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op3_paragraph_dedup(spark, str(tmp_path)).collect()}
    assert {i: x.removed for i, x in got.items()} == {0: "", 1: "", 2: "2,3,4,5,6,8", 3: "0", 4: "2"}
    assert [got[i].class_id for i in range(5)] == [0, 1, 1, 1, 4]  # by the passage; a short line makes no copy


def test_runs_bring_their_cuts_along():
    """A passage of over 50 words, wherever it stands, shares a stretch of runs of 20 words or more; one word repeated is one run."""
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(200):
        passage = [r.choice(vocabulary) for _ in range(r.randint(51, 70))]
        for _ in range(2):
            texts.append(" ".join([r.choice(vocabulary) for _ in range(r.randint(0, 40))] + passage + [r.choice(vocabulary) for _ in range(r.randint(0, 40))]).encode())
    texts += [b"", b"one", b"de " * 500, b" ".join(b"a%d" % i for i in range(15))]
    w = decontaminate.Words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), passages.KIND)
    begin, end = passages.runs(w, 16)
    assert (w.text[begin] == w.text[end - 1]).all() and (end - begin).sum() == len(w.hash)
    keys, text = passages.span_keys(w, begin, end), w.text[begin]
    size = dict(zip(keys.tolist(), (end - begin).tolist()))
    for a in range(0, 400, 2):
        both = set(keys[text == a].tolist()) & set(keys[text == a + 1].tolist())
        assert sum(size[k] for k in both) >= 20
    assert (text == 402).sum() <= 3 and (text == 401).sum() == 1 and (text == 400).sum() == 0
    assert len(passages.runs(decontaminate.Words(np.zeros(0, np.uint8), np.zeros(2, np.int64), passages.KIND), 16)[0]) == 0


def test_passages_link_documents_and_short_lines_do_not(make):
    r = random.Random(2)
    word = lambda: f"w{r.randrange(5000)}"
    some = lambda n: [word() for _ in range(n)]
    planted = [some(r.randint(51, 90)) for _ in range(15)]
    common = " ".join(f"common{i}" for i in range(14))
    rows, has = [], {}
    for i in range(120):
        lines = [" ".join(some(r.randint(5, 60))) for _ in range(r.randint(1, 4))] + [common]
        if i % 2:
            k = r.randrange(15)
            has.setdefault(k, []).append(i)
            cut = r.choice([0, 17, 40])  # whole in a line of other words, or broken over several
            before, after = " ".join(some(9)), " ".join(some(11))
            lines.insert(r.randrange(len(lines)), before + " " + " ".join(planted[k][:cut]) + ("\n" if cut else "") + " ".join(planted[k][cut:]) + " " + after)
        rows.append((i, "\n".join(lines)))
    got = {x.doc_id: x for x in paragraphs.dedup_paragraphs(make(rows), least=1, wrapped=True).collect()}
    for docs in has.values():
        assert {got[i].class_id for i in docs} == {min(docs)}
        assert got[min(docs)].n_passages == 0 and all(got[i].n_passages == 1 for i in docs if i != min(docs))
    for i in range(0, 120, 2):
        assert got[i].class_id == i and got[i].n_passages == 0 and got[i].n_removed == (i > 0)
    texts = {x.doc_id: x.text for x in paragraphs.remove_repeats(make(rows), least=1, wrapped=True).collect()}
    for docs in has.values():
        for i in docs[1:]:
            words = dict(rows)[i].split()
            gone = {j for x in got[i].passages.split(",") for j in range(*map(int, x.split("-")))}
            assert texts[i].split() == [x for j, x in enumerate(words) if j not in gone and not (i > 0 and x in common.split())]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_documents_that_share_51_words_are_of_one_class(spark, size):
    """On whole tables: of the pairs of a document and the first that has 51 words in a row of it nine tenths at least share
    their class, and all do where these words are not a few repeated ones."""
    sf = f"/root/testdata/{size}"
    first, pairs, plain = {}, set(), set()
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        words = (r.text or "").lower().split()
        for k in range(len(words) - 50):
            window = tuple(words[k : k + 51])
            other = first.setdefault(hash(window), r.doc_id)
            if other != r.doc_id:
                pairs.add((r.doc_id, other))
                if len(set(window)) >= 20:
                    plain.add((r.doc_id, other))
    got = {r.doc_id: r.class_id for r in queries.op3_paragraph_dedup(spark, sf).collect()}
    missed = {(a, b) for a, b in pairs if got[a] != got[b]}
    assert pairs and len(missed) <= 0.1 * len(pairs) and not missed & plain


PARA = " ".join(f"token{i}" for i in range(40))


def test_simhash_sends_no_growing_table_through_the_driver(spark, monkeypatch):
    plans = []
    seen = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    cut, keep = simhash.cut, graph.Tables.keep
    monkeypatch.setattr(simhash, "cut", lambda df: (seen(df), cut(df))[1])
    monkeypatch.setattr(graph.Tables, "keep", lambda self, *parts: ([seen(df) for df in parts], keep(self, *parts))[1])
    docs = spark.range(60).selectExpr("id as doc_id", "concat('one two three four five ', id div 2) as text", "'x' as source")
    kept = simhash.keep_one(docs)
    seen(kept)
    assert kept.count() == 30
    joins = [line for p in plans for line in p.splitlines() if "Join " in line]
    assert len(joins) > 5 and all("strategy=merge" in line for line in joins)


def test_sketches_rule_out_no_pair_that_is_alike(spark):
    r = np.random.default_rng(4)
    base = [r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for n in (1, 2, 9, 40, 150, 700)]
    sets = [np.unique(np.r_[b[r.random(len(b)) < keep], r.integers(1, 1 << 63, more, dtype=np.uint64)]) for b in base for keep in (1, 0.97, 0.9, 0.85, 0.5) for more in (0, 1, len(b) // 10)]
    sets = [s for s in sets if len(s)]
    x = paragraphs.sketches(np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets))), len(sets))
    every = list(range(len(sets)))
    rows = [(k, every, True, s.view(np.int64).tolist(), len(s), *x[k].tolist()) for k, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "key long, hubs array<long>, lead boolean, s array<long>, n int, x0 long, x1 long, x2 long, x3 long")
    near = {(p.a, p.b) for p in paragraphs._near(table, 0.8).collect()}
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    alike = {(a, b) for a in every for b in every if a != b and both(a, b) >= 0.8 * (len(sets[a]) + len(sets[b]) - both(a, b))}
    assert len(alike) > 100 and alike <= near and len(near) < 0.5 * len(sets) ** 2


def test_paragraphs_read_texts_four_times(make, monkeypatch):
    """Units and bands come from one pass, sets, shared runs and passages from one each; one more reads sets alone."""
    passes, frame = [], type(make([]))
    run = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, *a: (passes.append(schema), run(self, f, schema, *a))[1])
    rows = [(1, PARA + "\nshort\n" + PARA), (2, "x\n\n" + PARA), (2, PARA), (None, PARA), (3, None), (4, "")]
    got = {x.doc_id: (x.n_lines, x.n_paragraphs, x.removed, x.class_id) for x in paragraphs.dedup_paragraphs(make(rows), least=1, wrapped=True).collect()}
    assert len(passes) == 5
    assert got[1][:2] == (3, 4) and got[2][:2] == (4, 3) and got[3][:2] == (0, 0) and got[4][:2] == (0, 0) and got[None] == (1, 1, "", None)


def test_words_keep_tables_of_powers():
    a, b = decontaminate.powers(3, 10), decontaminate.powers(3, 1000)
    assert a.base is b.base and a.tolist() == [3**k for k in range(10)] and b[999] == pow(3, 999, 1 << 64)
    assert len(decontaminate.powers(3, 0)) == 0 and decontaminate.powers(3, (1 << 20) + 1)[-1] == pow(3, 1 << 20, 1 << 64)
    text = "Ab  é\tCD\n".encode()
    w = decontaminate.Words(np.frombuffer(text * 2, np.uint8), np.array([0, 0, len(text), 2 * len(text), 2 * len(text)]), passages.KIND)
    assert [w.joined(i, 1) for i in range(6)] == [b"ab", "é".encode(), b"cd"] * 2
    assert w.text.tolist() == [1, 1, 1, 2, 2, 2] and w.hash[:3].tolist() == w.hash[3:].tolist() and len(set(w.hash.tolist())) == 3
