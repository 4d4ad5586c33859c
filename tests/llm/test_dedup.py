import hashlib
import random
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from perilframe.llm import common, exact_dedup, jaccard_join, line_dedup
from perilframe.llm.decontaminate import Tiler, annotate, tiles, tokens


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_jaccard(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    links = []
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in by[g] if j > i).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                links.append((i, j))
    group = roots(sets, links)
    return {i: (len(s), group[i]) for i, s in sets.items()}


def families(seed=3):
    """Short texts with random edits, so that links, near misses and chains mix; and copies."""
    r = random.Random(seed)
    rows = []
    for f in range(12):
        size = r.choice([6, 9, 20, 40, 90])
        base = [f"{r.randrange(50)}w{f}" for _ in range(size)]
        for _ in range(25):
            t = list(base)
            for _ in range(r.randint(0, max(1, size // 12))):
                t[r.randrange(size)] = str(r.randrange(50))
            rows.append((len(rows), " ".join(t[:r.randint(size * 3 // 4, size)] if r.random() < .3 else t)))
    return rows + [(len(rows), rows[0][1].upper()), (len(rows) + 1, ""), (len(rows) + 2, None), (len(rows) + 3, "one word")]


def test_jaccard_equals_brute_force(spark):
    for rows, k, num, den in ((families(), 4, 85, 100), (families(5), 5, 80, 100)):
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_jaccard(rows, k, num, den)


def test_jaccard_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard_join.jaccard_components(docs, 4, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_jaccard(rows, 4, 85, 100)


def test_jaccard_odd_rows(odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd).collect()]
    assert len(got) == odd.count()
    assert (None, 5, None) in got and (3, 0, 3) in got and (5, 0, 5) in got and got.count((7, 3, 7)) == 2 and (8, 3, 7) in got
    assert jaccard_join.jaccard_components(none).count() == 0


def test_shuffle_files_of_earlier_steps_go(spark, monkeypatch):
    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.rsplit("/", 1)[-1] for f in every.mkString("\n").split("\n") if f.endswith(".data")}

    def run(step):
        return step(spark.range(5000).groupBy((F.col("id") % 500).alias("k")).count().repartition(3, "count"))

    calls, freed = [], common.freed
    monkeypatch.setattr(common, "freed", lambda s: calls.append(1) or freed(s))
    was = files()
    sizes = [run(common.cut).count(), run(common.table).count()]
    first, until = files() - was, time.time() + 20
    assert sizes == [500, 500] and len(calls) == 2
    while files() & first and time.time() < until:  # those of the last step may stay until a later one
        run(common.table)
    gone = not files() & first
    assert gone


def test_close_sets_alone_are_shuffled(spark):
    rows = families(7)
    texts = spark.createDataFrame(rows, "id long, text string").withColumn("text", F.col("text").cast("binary"))
    sets = common.cut(jaccard_join.sets_of(texts, 4).where("n > 0"))
    pairs = common.cut(sets.select("id").join(sets.select(F.col("id").alias("pivot")), F.expr("id < pivot and pivot < id + 30")))
    got = {(r.id, r.pivot): r.link for r in jaccard_join.compared(pairs, sets, 85, 100).collect()}
    of = {r.id: set(r.s) for r in sets.collect()}
    assert got == {(a, b): 100 * len(of[a] & of[b]) >= 85 * len(of[a] | of[b]) for a, b in got} and len(got) == pairs.count() and any(got.values())
    plan = jaccard_join.compared(pairs, sets, 85, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map64") > 0


def test_exact_groups(spark, odd, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd).collect()}
    assert (7, 8, 3, False) in got and (8, 8, 3, True) in got and (3, 4, 2, False) in got and (4, 4, 2, True) in got
    assert (None, None, 1, False) in got and exact_dedup.exact_groups(none).count() == 0
    # Texts that differ only late, or by a proper prefix, part in a later round.
    rows = [(i, "a" * 5000 + t) for i, t in enumerate(["x", "y", "X", "x" * 40000, "x" * 40000, "É", "é"])]
    by = {r.doc_id: r for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [by[i].keep_id for i in range(7)] == [2, 1, 2, 4, 4, 5, 6]
    assert all(by[i].text_sha256 == hashlib.sha256(lower(t).encode()).hexdigest() for i, t in rows)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 14))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == levenshtein(a, b)


def test_edit_distance_up_to_a_bound():
    r = random.Random(2)
    ended = 0
    for _ in range(150):
        a = [r.choice("abcdeé ") for _ in range(r.randint(60, 200))]
        b = list(a) if r.random() < .6 else [r.choice("abcdeé ") for _ in range(r.randint(60, 200))]
        for _ in range(r.randint(0, len(b) // 3)):
            b[r.randrange(len(b))] = r.choice(["", "x", "ab"])
        a, b = "".join(a), "".join(b)
        most, true = max(len(a), len(b)) // 5, levenshtein(a, b)
        got = line_dedup.edit_distance(a, b, most)
        assert got == true if true <= most else most < got <= true
        ended += got < true
    assert ended > 20


def test_similar_in_turns(spark, monkeypatch):
    r = random.Random(4)
    base = ["".join(r.choice("abcdefgh ") for _ in range(80)) for _ in range(3)]
    norms = [b[:i] + "xyz"[:i % 4] + b[i + 3:] for b in base for i in range(0, 60, 6)]
    texts = common.cut(spark.createDataFrame([(i, f"k{i:02d}".encode(), t) for i, t in enumerate(norms)], "id long, key binary, norm string"))
    pairs = common.cut(spark.createDataFrame([(i, j) for j in range(len(norms)) for i in range(j)], "a long, b long"))
    turns = []
    whole = line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda p, *a: turns.append(p.count()) or whole(p, *a))
    got = {(bytes(x.a), bytes(x.b)) for x in line_dedup.similar_in_turns(pairs, texts, 80).collect()}
    assert got == {(f"k{i:02d}".encode(), f"k{j:02d}".encode()) for j, y in enumerate(norms) for i, x in enumerate(norms[:j])
                   if 100 * levenshtein(x, y) <= 20 * max(len(x), len(y))}
    assert len(turns) > 4 and sum(turns) == pairs.count() and max(turns) < 2 * line_dedup.TURN * len(norms)


def test_runs_in_turns_and_texts_of_wanted_lines(spark, monkeypatch):
    r = random.Random(6)
    words = [f"wörd{i}" for i in range(40)]
    base = [[r.choice(words) for _ in range(15)] for _ in range(4)]
    docs = [(i, "\n".join(" ".join(r.choice(words) if r.random() < .06 else w for w in base[r.randrange(4)]) for _ in range(6)), i) for i in range(30)]
    rows = common.cut(spark.createDataFrame([*docs, docs[0]], "doc_id long, text string, rk long").select("doc_id", "rk", "text"))
    lines = common.cut(line_dedup.fingerprints(rows, 5, line_dedup.BANDS).withColumn("id", F.xxhash64("key")))
    one = lines.dropDuplicates(["key"]).withColumn("comp", F.col("id"))
    pairs = lambda: {(x.a, x.b) for x in line_dedup.near_pairs(one, line_dedup.GRAM_BITS, 80, line_dedup.BANDS).collect()}
    calls = []
    monkeypatch.setattr(line_dedup, "cut", lambda df: calls.append(1) or common.cut(df))
    got = pairs()
    assert len(got) > 50 and len(calls) == line_dedup.BANDS // line_dedup.RUNS
    monkeypatch.setattr(line_dedup, "RUNS", line_dedup.BANDS)
    assert pairs() == got
    wanted = lines.where("line % 2 = 1").select("key", "rk", "line").distinct()
    texts = {bytes(x.key): x.norm for x in line_dedup.texts_of(rows.select("rk", "text"), wanted).collect()}
    assert texts == {bytes(x.key): " ".join(docs[x.rk][1].split("\n")[x.line].split()) for x in wanted.collect()}


def simhash(words):
    from perilframe.llm.common import word_hashes
    h = [int(x) for x in word_hashes(" ".join(sorted(set(words))).encode())]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_lines(rows):
    """{(doc, line)} to go, over lines of five words or more, near by SimHash and by edits, from their texts alone."""
    at = defaultdict(list)
    for d, t in rows:
        for i, line in enumerate((t or "").lower().split("\n")):
            words = re.sub(r"[!-/:-@\[-`{-~]", "", line).split()
            if len(words) >= 5:
                at[" ".join(words)].append((d, i))
    lines = sorted(at)
    sims = [simhash(x.split()) for x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if bin(sims[i] ^ sims[j]).count("1") <= 3
             and 5 * levenshtein(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j]))]
    group = roots(range(len(lines)), links)
    kept = {}
    for i, x in enumerate(lines):
        kept[group[i]] = min(kept.get(group[i], (9e9,)), min(at[x]))
    return {p for i, x in enumerate(lines) for p in at[x] if p != kept[group[i]]}


def test_lines_equal_brute_force(spark):
    r = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(3, 60))) for _ in range(30)]
    rows = []
    for d in range(40):
        text = []
        for line in r.sample(base, 4):
            w = line.split()
            if r.random() < .4:
                w[r.randrange(len(w))] += "x"
            text.append("  ".join(w).upper() + "." if r.random() < .3 else " ".join(w))
        rows.append((d, "\n".join(text)))
    got = {(x.doc_id, x.line) for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_lines_odd_rows(spark, odd, none):
    kept = line_dedup.without_lines(odd)
    assert kept.columns == odd.columns and line_dedup.without_lines(none).count() == 0
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    # Repeated rows are treated alike; 8 repeats 7 and loses its only line.
    assert rows.count((7, "one two three four five six seven")) == 2 and 8 not in [d for d, _ in rows]
    assert (3, None) in rows and (4, "") in rows and (5, "   \n\t") in rows
    report = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.line_report(odd).collect()}
    assert report[8] == (1, "0") and report[3] == (0, "") and report[5] == (2, "")


def test_lines_kept_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e f\nshort\nq r s t u"), (2, "x\nA b c, d e f!\nv w x y z\nshort")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.without_lines(docs).collect()} == {1: "a b c d e f\nshort\nq r s t u", 2: "x\nv w x y z\nshort"}


def greedy(a, b, least):
    """Longest common unmarked runs, one at a time, in the plainest way."""
    ua, ub, out = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ua and j + n not in ub:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if not best:
            return out
        out.append(best)
        ua |= set(range(best[0], best[0] + best[2]))
        ub |= set(range(best[1], best[1] + best[2]))


def test_tiles_equal_greedy():
    r = random.Random(4)
    for _ in range(60):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 25))] for _ in range(2))
        got = tiles(tokens(" ".join(a).encode()), tokens(" ".join(b).encode()), 3)
        assert got == greedy(a, b, 3)


def test_decontamination(spark, odd, none):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item), (2, "nothing of this is anywhere in the texts"), (3, None), (4, "too short")], "item_id long, text string")
    turned = "filler theta iota, KAPPA lambda mu x y alpha beta gamma delta epsilon and more"
    docs = spark.createDataFrame([(1, "before " + item.lower() + " after"), (2, turned), (3, "alpha beta x gamma delta y epsilon zeta"), (4, None)], "doc_id long, text string")
    for limit in (10**6, 0):  # by broadcast, and by shuffled join
        got = {r.row.doc_id: (round(r.coverage, 3), list(r["items"])) for r in annotate(docs, bench, limit=limit).collect()}
        assert got == {1: (1.0, [1]), 2: (0.833, [1]), 3: (0.0, []), 4: (0.0, [])}
        assert annotate(odd, bench, limit=limit).select("row.*").columns == odd.columns
        assert annotate(odd, bench, limit=limit).count() == odd.count() and annotate(none, bench, limit=limit).count() == 0
    assert annotate(docs, bench.limit(0)).where("size(items) > 0").count() == 0


def test_both_ways_of_decontamination_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one, two = ({(r.row.doc_id, round(r.coverage, 9), tuple(r["items"])) for r in annotate(docs, bench, limit=n).collect()} for n in (10**6, 0))
    assert one == two and any(i for _, _, i in one)
    items = [(r.item_id, r.text.encode()) for r in bench.collect()]
    tiler = Tiler(items, 5, 0.5)
    for d in docs.limit(60).collect():
        best = max(sum(n for _, _, n in tiles(tokens(t), tokens(d.text.encode()))) / len(tokens(t)) for _, t in items)
        assert best == (tiler.covered(d.text.encode()) or [(0.0, 0)])[0][0]


def test_texts_fingerprinted_together_give_what_each_gives_alone():
    rnd = random.Random(7)
    words = ["alpha", "Beta,", "γάμμα", "delta", "x", "ΣΊΣΥΦΟΣ"]
    texts = ["\n".join(" ".join(rnd.choices(words, k=rnd.randrange(12))) for _ in range(rnd.randrange(6))) for _ in range(60)]
    raws = [line_dedup.lowered(t) for t in [*texts, "", "\n\n", " ".join(words * 100), ""]]
    row = lambda i, found: [(i + int(t), int(n), k.tobytes(), int(s)) for t, n, k, s in zip(*found, strict=True)]
    alone = [x for i, raw in enumerate(raws) for x in row(i, line_dedup.lines_of([raw], 5))]
    assert row(0, line_dedup.lines_of(raws, 5)) == alone and len(alone) > 60
    assert row(0, line_dedup.lines_of([], 5)) == []


def similar_lines(rows):
    """Distinct normal forms of lines of five words or more, and all pairs of them with an edit similarity of 0.8 or more."""
    lines = sorted({" ".join(w) for _, t in rows for x in (t or "").lower().split("\n") if len(w := re.sub(r"[!-/:-@\[-`{-~]", "", x).split()) >= 5}, key=len)
    pairs = []
    for j, y in enumerate(lines):
        for x in reversed(lines[:j]):
            if 5 * len(x) < 4 * len(y):
                break
            if sum((Counter(x) - Counter(y)).values()) * 5 <= len(y) and 5 * line_dedup.edit_distance(x, y) <= len(y):
                pairs.append((x, y))
    return lines, pairs


def joined_share(spark, rows, pairs):
    """Share of the pairs of lines that fuzzy deduplication leaves in one group."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.duplicate_lines(docs, **line_dedup.FUZZY).collect()
    texts = {d: t.lower().split("\n") for d, t in rows if t}
    norm = lambda d, i: " ".join(re.sub(r"[!-/:-@\[-`{-~]", "", texts[d][i]).split())
    group = {norm(r.doc_id, r.line): (r.keep_doc, r.keep_line) for r in found}
    group |= {norm(d, i): (d, i) for d, i in set(group.values())}
    return sum(x in group and group[x] == group.get(y) for x, y in pairs) / len(pairs)


def test_fuzzy_lines_recall_against_edit_similarity(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    _, pairs = similar_lines(rows)
    assert len(pairs) > 20 and joined_share(spark, rows, pairs) >= 0.9
    rnd = random.Random(11)
    syllables = ["ba", "tre", "lo", "min", "ka", "sur", "ed", "ing", "po", "vel"]
    vocabulary = ["".join(rnd.choices(syllables, k=rnd.randint(2, 4))) for _ in range(4000)]
    for size in (5, 10, 20, 50):  # one word replaced
        pairs = []
        while len(pairs) < 100:
            x = rnd.choices(vocabulary, k=size)
            y = list(x)
            y[rnd.randrange(size)] = rnd.choice(vocabulary)
            x, y = " ".join(x), " ".join(y)
            if x != y and 5 * levenshtein(x, y) <= max(len(x), len(y)):
                pairs.append((x, y))
        assert joined_share(spark, [(i, t) for i, t in enumerate(t for p in pairs for t in p)], pairs) >= 0.9, size


def test_lines_of_one_simhash_are_all_compared(spark):
    # The same words, one moved at a time: neighbours are similar, the ends are not, and all have one SimHash.
    rnd, rows = random.Random(5), []
    for f in range(6):
        line = [f"{rnd.choice('abcdefgh')}{rnd.randrange(1000)}x{f}" for _ in range(14)]
        for _ in range(8):
            rows.append((len(rows), " ".join(line)))
            line.append(line.pop(rnd.randrange(len(line) - 1)))
    rnd.shuffle(rows)
    want = brute_lines(rows)
    got = lambda **kw: {(x.doc_id, x.line) for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()}
    assert got() == want and len(want) == 42 and got(**line_dedup.FUZZY) >= want
