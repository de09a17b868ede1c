import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docgraph.llm import chat, decontaminate, mixing, quality, queries, rules, sharding, toxicity

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontaminate_equals_brute_force(spark, make):
    r = random.Random(2)
    vocabulary = ["a", "B", "cé", "d7", "e", "Éf"]
    text = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ".", ","]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((14, 10, 9, 4, 1, 0, 30, 11))] + [(99, None), (None, "a b")]
    docs = [(i, " ".join([text(r.randint(0, 30)), r.choice(items)[1] or "", text(5)])) for i in range(50)] + [(70, None), (71, ""), (72, "...")]
    windows = {}
    for i, t in items:
        w = words(t)
        if w and i is not None:
            for k in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = {}
    for i, t in docs:
        w, hit, seen = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    seen |= found
        want[i] = (len(w), len(hit), sorted(seen))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (16 << 20, 60):  # one block, and several
        found = decontaminate.matches(make(docs), bench, block_bytes=size)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        blocks = -(-sum(len((t or "").encode()) for i, t in items if i is not None) // size)
        assert plan.count("MapInArrow") == blocks == (1 if size > 60 else 5)  # a matching pass a block, and no more
        got = found.collect()
        assert {x.doc_id: (x.n_words, sum(x.spans[1::2]) - sum(x.spans[::2]), x["items"]) for x in got} == want


def test_decontaminate_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog while seven wizards")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.doc_id for r in odd.collect()} - {r.doc_id for r in decontaminate.remove_contaminated(odd, bench).collect()} == {1, 2, 8, None}
    assert decontaminate.remove_contaminated(odd, none).count() == odd.count()
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.remove_contaminated(odd, bench).columns == odd.columns


def test_decontaminate_in_blocks_equals_one_block(spark, odd, make):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("abcde") for _ in range(n))
    bench = spark.createDataFrame([(i, text(r.choice([3, 10, 12, 25]))) for i in range(40)], "item_id long, text string")
    docs = make([(i, " ".join([text(20), r.choice(bench.collect())[1], text(6)])) for i in range(20)]).select("doc_id", "text")
    docs = docs.unionByName(docs.limit(3)).unionByName(odd.select("doc_id", "text"))
    one, many = (sorted(map(tuple, decontaminate.matches(docs, bench, block_bytes=b).collect()), key=str) for b in (1 << 20, 100))
    assert one == many and any(x[2] for x in one)
    assert decontaminate.matches(docs, bench, block_bytes=100).count() == docs.count()


def test_sharding(spark, odd, empty, make):
    docs = make([(i, "t" * (i % 9)) for i in range(3000)])
    got = sharding.shard_documents(docs, 16, slice_rows=20).toPandas()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    moved = got[got.shard != got.grown_shard]
    assert (moved.grown_shard == 16).all() and 100 < len(moved) < 260
    assert got.groupby("shard").size().between(130, 250).all()
    assert (got["size"] == got.doc_id % 9 + 1).all()
    assert (got.text_crc32 == [zlib.crc32(b"t" * (i % 9)) for i in got.doc_id]).all()
    o = sharding.shard_documents(odd).collect()
    assert len(o) == odd.count() and {r["size"] for r in o if r.doc_id in (3, 4, 11)} == {1}
    assert len({r.shard for r in o if r.doc_id == 1}) == 1
    assert sharding.shard_documents(empty).count() == 0
    for n in (1, 2, 50):
        keys = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert ((a == b) | (b == n)).all() and a.min() >= 0 and a.max() < n
    with pytest.raises(ValueError):
        sharding.jump(np.zeros(1, np.uint64), 0)


def filled(sizes, weights, most):
    """Targets by resharing the excess until none is above its cap."""
    total, left, out = sum(sizes), dict(enumerate(sizes)), {}
    while left:
        level = (total - sum(out.values())) / sum(weights[i] for i in left)
        over = [i for i, s in left.items() if level * weights[i] > most * s]
        if not over:
            out |= {i: level * weights[i] for i in left}
            break
        out |= {i: most * left.pop(i) for i in over}
    return [out[i] for i in range(len(sizes))]


def test_mixing(make):
    r = random.Random(4)
    names = ["b", "a", None, "c", "Z", "é"]
    docs = [(i, "w " * r.randint(0, 300), names[min(5, int(r.expovariate(0.5)))]) for i in range(900)]
    got = mixing.copies(make(docs)).toPandas()
    order = sorted([n for n in {d[2] for d in docs} if n is not None]) + [None]
    sizes = [sum(len(t.split()) for _, t, s in docs if s == n) for n in order]
    goal = dict(zip(order, filled(sizes, [(1, 2, 3)[i % 3] for i in range(len(order))], 3)))
    assert got.copies.between(0, 3).all() and len(got) == len(docs)
    for n in order:
        g = got[got.source.isna() if n is None else got.source == n]
        assert g.target.iloc[0] == pytest.approx(goal[n])
        assert (g["size"] * g.copies).sum() == pytest.approx(goal[n], rel=0.02, abs=40)
        # longer documents never have more certain copies, and the last copy is one at most
        g = g[g["size"] > 0].sort_values("size")
        assert (g.copies.cummin() + 1 >= g.copies).all()
    again = mixing.copies(make(docs[::-1])).toPandas()
    assert dict(zip(got.id, got.copies)) == dict(zip(again.id, again.copies))
    mixed = Counter(x.doc_id for x in mixing.mix(make(docs)).collect())
    assert mixed == {i: c for i, c in zip(got.id, got.copies) if c}


def test_pareto_inclusion_rates(make):
    """Over many draws documents of a size are taken as often as their expected copies say: certain copies always, the rest at
    their odds. What fills the gap at the end adds a few short documents a source."""
    sizes = [n for n in (3, 5, 8, 13, 21, 34, 55, 89, 144, 233) for _ in range(30)]
    rounds, taken = 40, Counter()
    docs = [(1000 * j + i, "w " * n, f"s{j:03}") for j in range(rounds) for i, n in enumerate(sizes)]
    for x in mixing.copies(make(docs), weights=(3, 5)).collect():
        taken[int(x.source[1:]) % 2, x["size"], x.copies] += 1
    for odd in (0, 1):
        target = sum(sizes) * (0.75, 1.25)[odd]
        low, high = 0.0, 1e9
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(n * min(3, c / n**0.5) for n in sizes) < target else (low, c)
        for n in set(sizes):
            want, got = min(3, c / n**0.5), {k: taken[odd, n, k] for k in range(4) if taken[odd, n, k]}
            assert set(got) <= {int(want), int(want) + 1} and sum(got.values()) == 600
            assert abs(sum(k * v for k, v in got.items()) / 600 - want) < 0.08  # four standard errors


def test_mixing_odd(odd, empty):
    got = mixing.copies(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.copies <= 3 for r in got)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.copies(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_chat_round_trip(spark):
    r = random.Random(6)
    bits = ["</s>", "[INST] ok [/INST]", "\\", "\\l", "<", "]", "é", "\n", "中", "[TURN:x] ", " ", "plain"]
    rows = [(r.choice([None, *range(12)]), r.choice([None, 0, 1, 2]), r.choice(["user", "assistant", "system", "to[o]l\\<", None, ""]), r.choice([None, "".join(r.choice(bits) for _ in range(r.randint(0, 9)))])) for _ in range(150)]
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], "conv_id long, turn long, role string, text string, formatted string, loss int")
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for arrow in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
        got = {x.conv_id: x for x in chat.format_conversations(df).collect()}
        assert set(got) == set(want)
        for c, turns in want.items():
            turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
            assert chat.read_back(got[c].formatted) == [x[1:] for x in turns]
            masked = [chat.unescape(got[c].formatted[a:b]) for a, b in zip(got[c].loss[::2], got[c].loss[1::2])]
            assert masked == [x[2] for x in turns if x[1] == "assistant"]
            outside = got[c].formatted.replace("[INST]", "").replace("[/INST]", "")
            assert outside.count("</s>") == len(masked)
    with pytest.raises(ValueError):
        chat.read_back("[INST] a [/INST]x")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_in_bounded_pieces():
    import pyarrow as pa

    table = pa.table({"conv_id": [1, 1, 2, 3, 3, 3, 4], "role": ["user"] * 7, "text": ["aa", "b", "c" * 9, None, "d", "e", "ff"]})
    for most in (1, 3, 5, 100):
        parts = list(chat._bounded(table, most))
        assert pa.concat_tables(parts).equals(table)
        ids = [set(p.column("conv_id").to_pylist()) for p in parts]
        assert sum(map(len, ids)) == 4 and all(len(i) == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= most for i, p in zip(ids, parts))


def test_rules_equal_their_sql(make, tmp_path):
    """The line rules in SQL, on lines of every length that each rule is about."""
    import duckdb

    from docgraph.llm import oracles

    r = random.Random(12)
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    lines = [prose, prose[:-1] + " all rights reserved, privacy policy.", "x" * 250, "buy now " * 8 + "again.", "buy now now buy " * 30 + "end.", "Home", "A B C D", "# # a"]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 6)))) for i in range(200)] + [(300, None), (301, "")]
    make(docs).write.parquet(f"{tmp_path}/d")
    want = duckdb.connect().execute(f"with documents as (select * from '{tmp_path}/d/*.parquet') select doc_id, kept, n_repeat_words from ({oracles.line_rules()})").fetchall()
    assert sorted(want) == sorted((x.doc_id, x.kept, x.n_repeat_words) for x in rules.assess(make(docs)).collect())


def test_chat_probe(spark, sf):
    row = queries.op8_chat(spark, sf).where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (row.loss_chars, row.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_rules(make, odd, empty):
    r = random.Random(8)
    texts = [(i, "\n".join(" ".join(r.choice(["a", "bb", "#c", "d|", "é"]) for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 9)))) for i in range(120)]
    space = re.compile("[^\x20\x09-\x0d]+")
    for x in rules.assess(make(texts)).collect():
        t = dict(texts)[x.doc_id]
        w = space.findall(t)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [line for line in t.split("\n") if space.search(line)]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert x.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (x.base_failed and x.kept)
    got = {r.doc_id: r for r in rules.assess(odd).collect()}
    assert len(rules.assess(odd).collect()) == odd.count() and not got[3].kept and got[4].n_words == 0 and got[7].n_words > 100_000
    assert rules.assess(empty).count() == 0
    good = " ".join(f"Some{i} plain{i} sentence{i} numbers{i} stand{i} here{i}." for i in range(20))
    bad = "Home\nAll rights reserved.\n" + "BUY NOW AND SAVE TODAY!\n" * 2 + "a | b | c | d"
    kept = {x.doc_id: x for x in rules.assess(make([(1, good + "\n" + good[:24] + "."), (2, good + "\nHome\n" + bad), (3, good[:300] + "\n" + bad * 9)])).collect()}
    assert kept[1].kept and kept[1].n_bad_lines == 0
    assert kept[2].n_bad_lines == 6 and kept[2].kept and kept[2].cleaned == good
    assert not kept[3].kept


def line_fails(line):
    w = re.findall("[^\x20\x09-\x0d]+", line)
    distinct, symbols = len(set(w)), sum(line.count(c) for c in "#*$%&|<>")
    return bool(
        (len(w) < 10 and not re.search(r"[.!?:;)\"'][ ]*$", line))
        or re.search("(?i)^ *(home|menu|next) *$", line)
        or re.search("(?i)(all rights reserved|privacy policy|click here)", line)
        or symbols * 10 >= len(w)
        or (len(w) >= 4 and line.upper() == line != line.lower())
        or (len(w) >= 8 and distinct * 3 <= len(w))
        or any(len(set(w[i : i + 5])) == 1 for i in range(len(w) - 4))
    )


def test_line_rules_hold_for_every_length(make):
    r = random.Random(12)
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    lines = [prose, prose[:-1] + " all rights reserved, privacy policy.", "x" * 250, "y" * 250 + ".", "buy now " * 8 + "again.", "buy now now buy " * 30 + "end.", "a a a a a end of the line is here now."]
    vocabulary = [["red", "blue"], ["red", "blue", "HOME", "green"], [f"v{i}" for i in range(40)], ["z" * 40, "Click", "here", "#", "UP"]]
    for _ in range(150):
        v = r.choice(vocabulary)
        lines.append(" ".join(r.choice(v) for _ in range(r.randint(1, 60))) + r.choice(["", "."]))
    got = {x.doc_id: x.n_bad_lines for x in rules.assess(make(list(enumerate(lines)))).collect()}
    assert [got[i] for i in range(7)] == [0, 1, 1, 0, 1, 1, 1]
    assert got == {i: int(line_fails(line)) for i, line in enumerate(lines)}


def test_folding():
    assert toxicity.fold("Ｉd1оt") == " idiot " and toxicity.fold("m0r0n! 2024, a$$h") == " moron 2024 assh "
    assert toxicity.fold("") == "  " and toxicity.fold("7 9") == " 7 9 "


def test_folding_of_capitals():
    capitals, small = "АВЕКМНОРСТУХІЈЅԀѴΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abekmhopctyxijsdvabezhikmnoptyx"
    for a, b in zip(capitals, small, strict=True):
        assert toxicity.fold(a) == f" {b} "
    assert toxicity.fold("МОRОN Мoron ΜΟRΟΝ ＭＯＲＯＮ") == " moron moron moron moron "
    assert toxicity.Lexicon({"moron": 3.0}).matcher()("You МОRОΝ") == (3.0, 2)


def test_lexicon():
    hits = toxicity.Lexicon({"moron": 3.0, "lowe*": 2.0}, ("no moron",)).matcher()
    assert hits("You M0R0N, moron moronic") == (6.0, 4)
    assert hits("lowei Lowenta slower") == (4.0, 3)
    assert hits("no moron here, moron") == (3.0, 4)
    assert hits("") == (0.0, 0) and toxicity.Lexicon({}).matcher()("x") == (0.0, 1)


def test_matching_equals_naive_search():
    """Hits are the terms that stand at a word's begin in the folded text, the heaviest of each place, outside exception phrases."""
    r = random.Random(9)
    stock = ["vile", "vil", "vilest", "no", "m0ron", "moron", "Мoron", "a", "worm"]
    lexicon = toxicity.Lexicon({"moron": 3.0, "vil*": 2.0, "vilest": 5.0, "no moron": 1.0, "worm": 1.5}, ("no moron", "a vile", "vile a worm"))
    hits = lexicon.matcher()
    for _ in range(300):
        text = " ".join(r.choice(stock) for _ in range(r.randint(0, 25)))
        t = toxicity.fold(text)
        excused = [(i, i + len(p) + 1) for p in lexicon.exceptions for i in range(len(t)) if t.startswith(f" {p} ", i)]
        total = 0.0
        for i in range(len(t)):
            here = [w for term, w in lexicon.weights.items() if t.startswith(f" {term[:-1]}" if term.endswith("*") else f" {term} ", i)]
            if here and not any(a <= i < b for a, b in excused):
                total += max(here)
        assert hits(text) == (pytest.approx(total), len(text.split()))


def test_seeds_and_exceptions_for_stems(spark, make):
    r = random.Random(2)
    clean = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(300):
        t = [r.choice(clean) for _ in range(30)]
        if i % 5 == 0:
            t[4] = r.choice(["vilexa", "vilexb", "vilexc", "vilexd"])
        elif i % 5 == 1:
            t[7:9] = ["castle", "vilexa"]
        docs.append((i, " ".join(t)))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    lexicon = toxicity.fit(make(docs), labels, lift=1.5, surprise=5.0, seeds=("Abschaum", "w3"))
    assert "abschaum" in lexicon.weights and "w3" not in lexicon.weights
    assert "castle vilexa" in lexicon.exceptions
    hits = lexicon.matcher()
    assert hits("you ABSCHАUM")[0] > 0 and hits("the castle vilexa")[0] == 0 < hits("the vilexa")[0]


def test_toxicity_learns(spark, make, odd, empty):
    r = random.Random(1)
    clean = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(400):
        t = [r.choice(clean) for _ in range(40)]
        if i % 4 == 0:
            t[r.randrange(40)] = r.choice(["vilexa", "vilexb", "scumbag"])
        docs.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    lab = spark.createDataFrame(labels[:300], "doc_id long, toxic int")
    lexicon = toxicity.fit(make(docs), lab)
    assert "scumbag" in lexicon.weights and any(k.startswith("vile") for k in lexicon.weights) and len(lexicon.weights) <= 4
    got = {x.doc_id: x.score for x in toxicity.score(make(docs[300:]), lexicon).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, y in labels[300:])
    assert toxicity.score(odd, lexicon).count() == odd.count() and toxicity.score(empty, lexicon).count() == 0
    nothing = toxicity.fit(make(docs), lab.limit(0))
    assert nothing.weights == {} and 0 <= toxicity.score(odd, nothing).first().score <= 1


def test_attention_gradient():
    r = np.random.default_rng(0)
    x, text, y = r.normal(size=(9, quality.FEATURES)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0, 1, 0])
    model = quality.train(x, text, y, width=4, epochs=1)
    loss = lambda: -sum(t * np.log(s) + (1 - t) * np.log(1 - s) for t, s in zip(y, model.forward(x, text, 4)[-1]))
    g, _ = model.gradient(x, text, y, np.ones(4))
    for name in model.p:
        p = np.atleast_1d(model.p[name]).astype(float)
        for at in [tuple(0 for _ in p.shape), tuple(n - 1 for n in p.shape)]:
            found = []
            for step in (1e-5, -1e-5):
                q = p.copy()
                q[at] += step
                keep, model.p[name] = model.p[name], q if np.ndim(model.p[name]) else q[0]
                found.append(loss())
                model.p[name] = keep
            assert np.atleast_1d(g[name])[at] == pytest.approx((found[0] - found[1]) / 2e-5, abs=1e-5)


def test_quality_learns(spark, make, odd, empty):
    r = random.Random(3)
    good = lambda: " ".join(r.choice(["the", "harbour", "was", "quiet", "again."]) for _ in range(r.randint(5, 200)))
    bad = lambda: " ".join(r.choice(["BUY!!", "###", "x|y", "$$$"]) for _ in range(60))
    docs = [(i, good() if i % 3 else good() + " " + bad() + " " + good()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    model = quality.fit(make(docs), labels)
    got = {x.doc_id: x.score for x in quality.score(make(docs[200:]), model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in got]) >= 0.97
    assert quality.score(odd, model).count() == odd.count() and quality.score(empty, model).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns
    flat = quality.fit(make(docs), labels.limit(0))
    assert {x.score for x in quality.score(odd, flat).collect()} == {0.5}


def test_passages():
    texts = [b"", b"one", b" ".join(b"w%d" % i for i in range(85)), b"\n\n"]
    off = np.cumsum([0, *map(len, texts)])
    x, text = quality.passages(np.frombuffer(b"".join(texts), np.uint8), off)
    assert text.tolist() == [0, 1, 2, 2, 2, 3] and x.shape == (6, quality.FEATURES)
    assert not x[0].any() and not x[-1].any() and np.isfinite(x).all()


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        if name != names[-1]:
            assert out.columns == docs.columns
            if name != "source_mix":
                assert out.count() <= at.count() and out.count() > 0
        at = out
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, rows)) == sorted(map(str, at.collect()))
    mixed = Counter(r.doc_id for r in rows)
    assert max(mixed.values()) <= 3


def test_pipeline_stages_equal_brute_force(spark, sf):
    """Each stage's rows on its own input, from plain loops: scores per document, components by all pairs, windows by search,
    expected copies by bisection, the scalar jump hash."""
    import corpus_pipeline
    from test_dedup import fingerprint_by_loops

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    model = quality.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    kept = {r.doc_id for r in stages["quality_classifier"](spark, docs, sf).collect()}
    assert kept == {i for i, r in rows.items() if score_by_loops(model, r.text or "") >= 0.5}

    docs = docs.where(docs.doc_id.isin(list(kept)))
    fp = {i: fingerprint_by_loops(rows[i].text or "") for i in kept}
    label = {i: i for i in kept}
    for a in sorted(kept):
        for b in kept:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    kept = {r.doc_id for r in stages["simhash_near_dedup"](spark, docs, sf).collect()}
    assert kept == {i for i, x in label.items() if i == x}

    docs = docs.where(docs.doc_id.isin(list(kept)))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {f" {' '.join(w[k : k + 10])} " for k in range(max(1, len(w) - 9))} if w else set()
    kept = {r.doc_id for r in stages["benchmark_decontamination"](spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in docs.collect() if not any(x in f" {' '.join(words(r.text))} " for x in windows)}

    docs = docs.where(docs.doc_id.isin(list(kept)))
    mixed = stages["source_mix"](spark, docs, sf)
    copies = Counter(r.doc_id for r in mixed.collect())
    by = {}
    for r in docs.collect():
        by.setdefault(r.source, []).append((r.doc_id, len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))))
    order = sorted(x for x in by if x is not None) + [x for x in by if x is None]
    for source, target in zip(order, filled([sum(n for _, n in by[s]) for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))], 3)):
        low, high = 0.0, 1e9
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(n * min(3, c / n**0.5) for _, n in by[source] if n) < target else (low, c)
        for i, n in by[source]:
            assert copies[i] in ((int(min(3, c / n**0.5) + 1e-4), int(min(3, c / n**0.5) + 1e-4) + 1, int(min(3, c / n**0.5) - 1e-4)) if n else (0,))
        assert sum(n * copies[i] for i, n in by[source]) <= target + 1e-6

    got = stages["sharding"](spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in got) == copies
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({(r.doc_id, r.shard) for r in got}) == len(copies)


def score_by_loops(model, text):
    """The model's score of one text, a passage and a unit at a time; only the passages' counts are the operator's own."""
    data = np.frombuffer(text.encode(), np.uint8)
    x, _ = quality.passages(data, np.array([0, len(data)]))
    p, units = model.p, len(model.p["b"])
    hidden, energy = [], []
    for row in np.clip((x - model.mean) / model.scale, -6, 6):
        h = [np.tanh(sum(row[i] * p["W"][i][j] for i in range(len(row))) + p["b"][j]) for j in range(units)]
        v = [np.tanh(sum(h[i] * p["V"][i][j] for i in range(units))) for j in range(units)]
        u = [1 / (1 + np.exp(-sum(h[i] * p["U"][i][j] for i in range(units)))) for j in range(units)]
        hidden.append(h)
        energy.append(sum(v[j] * u[j] * p["w"][j] for j in range(units)))
    a = [np.exp(e - max(energy)) for e in energy]
    z = [sum(a[k] * hidden[k][j] for k in range(len(a))) / sum(a) for j in range(units)]
    return 1 / (1 + np.exp(-np.clip(sum(z[j] * p["c"][j] for j in range(units)) + p["d"], -30, 30)))


def test_scores_equal_a_plain_forward_pass(spark, make):
    r = random.Random(5)
    texts = [(i, " ".join(r.choice(["The", "old", "harbour.", "x|y", "#9", "é"]) for _ in range(r.randint(0, 130)))) for i in range(25)] + [(90, None), (91, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = quality.fit(make(texts), labels, epochs=3)
    got = {x.doc_id: x.score for x in quality.score(make(texts), model).collect()}
    assert got == {i: pytest.approx(score_by_loops(model, t or ""), abs=1e-9) for i, t in texts}


def test_jump_equals_the_scalar_loop():
    def jump(key, shards):
        b, j = -1, 0
        while j < shards:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = [random.Random(i).getrandbits(64) for i in range(500)] + [0, 1, (1 << 64) - 1]
    for shards in (1, 2, 7, 16, 17, 1000):
        assert sharding.jump(np.array(keys, np.uint64), shards).tolist() == [jump(k, shards) for k in keys]


def test_null_ids_are_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "some words here"), (2, None), (3, "more words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op6_toxicity", "op9_quality"):
        rows = queries.queries()[name](spark, str(tmp_path)).collect()
        assert len(rows) == 3 and all(r.held_out in (True, False) and 0 <= r.score <= 1 for r in rows)
