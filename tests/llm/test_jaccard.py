"""Components of the Jaccard join against brute force over real shingle texts."""

import random
import re

import pytest

from auditloom.llm import jaccard

SCHEMA = "doc_id long, text string, n long, cls string, place long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                c = len(a & b)
                if 100 * c >= 75 * (len(a) + len(b) - c):
                    top[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min([x for x in (least.get(find(i)), k) if x is not None], default=None)
    return sorted(
        ((k, len(s), least[find(i)] if s else k) for i, (k, s) in enumerate(sets)),
        key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def got(spark, rows):
    df = spark.createDataFrame([(k, t, 7, "x", 3) for k, t in rows], SCHEMA)
    out = jaccard.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(map(tuple, out), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def edited(rng, words, share):
    return [rng.choice("uvwxyz") + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5)))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 20, 80, 300]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            text = edited(rng, base, rng.choice([0, 0.005, 0.02, 0.04, 0.06]))
            if rng.random() < 0.4:
                text = passage + text
            rows.append(rng.choice([" ", "\n", "\t "]).join(text))
    big = [word() for _ in range(200)]
    rows += [" ".join(edited(rng, big, rng.choice([0.01, 0.03]))) for _ in range(60)]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # full meeting places and opened groups at this size too
        monkeypatch.setattr(jaccard, "PLACE_ROWS", 7)
        monkeypatch.setattr(jaccard, "LEADERS", 1)
        monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 60)
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(5, None), (4, ""), (9, " \n"), (3, "A b"), (8, "a  B"), (8, "a B"), (None, "a b"), (2, "a b c"),
            (7, long), (6, long + " end"), (1, "é É x")]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_class_that_leads_one_salt_and_follows_in_another(spark, monkeypatch):
    """L and C in salt 1, C and F in salt 0, and F alone is similar to Y, which lies elsewhere."""
    monkeypatch.setattr(jaccard, "PLACE_ROWS", 2)
    rng = random.Random(8)

    def told(words):
        u = next(jaccard.shingle_sets([" ".join(words).encode()]))
        return u, jaccard.class_of(u), jaccard.place_of(u)

    def near(a, b):
        return jaccard.linked(a[0], b[0], 75)[0]

    for _ in range(2_000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        texts = [["l%d" % i for i in range(15)] + base, base, base + ["e%d" % i for i in range(25)],
                 base[20:] + ["e%d" % i for i in range(30)]]
        low, mid, far, out = map(told, texts)
        if (low[1] < mid[1] < far[1] and low[2] == mid[2] == far[2] != out[2]
                and near(low, mid) and near(mid, far) and near(far, out)
                and not near(low, far) and not near(low, out) and not near(mid, out)):
            break
    else:
        raise AssertionError("no such texts")
    turns = spark.range(100).selectExpr("id", "pmod(pmod(xxhash64(id), 1 << 30), 2) as turn").collect()
    even, odd = ([r.id for r in turns if r.turn == t] for t in (0, 1))
    ids = [(odd[0], 0), (odd[1], 1), (even[0], 1), (even[1], 2), (odd[2], 3)]
    rows = [(k, " ".join(texts[i])) for k, i in ids]
    parts = [spark.createDataFrame([r], "doc_id long, text string") for r in rows]
    df = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])  # copies in different tasks
    out = jaccard.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, out)) == brute(rows)
    assert len({r.component_id for r in out}) == 1


def test_one_of_each_goes_by_class(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, "c d e f g h"), (3, a + " end"), (4, b), (5, a), (5, "own text of five"), (6, b + " x"),
            (6, b + " y"), (7, "same same"), (7, "same same"), (8, None), (8, ""), (None, a), (None, a)]
    df = spark.createDataFrame([(i, t, 0, "row", 1) for i, t in rows], "doc_id long, text string, tk long, row string, place long")
    out = jaccard.one_of_each(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (1, b), (2, "c d e f g h"), (5, "own text of five"), (7, "same same"),
                          (8, None), (8, ""), (None, a), (None, a)], key=str)
    assert jaccard.one_of_each(df.limit(0)).collect() == []


def test_sizes_a_prefix_shingle_can_matter_to():
    """Similar sets share enough of the shingles that can matter to both, in any common order."""
    rng = random.Random(3)
    for _ in range(3_000):
        percent = rng.choice([50, 75, 90])
        n, m = rng.randrange(1, 80), rng.randrange(1, 80)
        common = rng.randrange(0, min(n, m) + 1)
        if 100 * common < percent * (n + m - common):
            continue
        order = [0] * common + [1] * (n - common) + [2] * (m - common)
        rng.shuffle(order)
        told = []
        for own, size in ((1, n), (2, m)):
            places = (i for i, x in enumerate(order) if x in (0, own))
            told.append(dict(zip(places, jaccard.most_partner(size, percent).tolist())))
        shared = sum(order[i] == 0 and told[0][i] >= m and told[1].get(i, 0) >= n for i in told[0])
        assert shared >= jaccard.shared_least(min(n, m)), (n, m, common, order)


def test_edits_too_far_from_each_other_do_not_meet(spark, monkeypatch):
    """Copies that are not similar to their original or to each other make no square of pairs."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 100):
        at = set(range(rng.randrange(23), 300, 23))  # five shingles for each edit: 0.64 to the original
        rows.append((i, " ".join(f"e{i}x{j}" if j in at else w for j, w in enumerate(base))))
    met, staged = {}, jaccard.staged

    def kept(df, purpose):
        met[purpose] = staged(df, purpose)
        return met[purpose]

    monkeypatch.setattr(jaccard, "staged", kept)
    assert got(spark, rows) == brute(rows)
    assert met["matrix"].where("kind = 1").count() < 60 and met["bound"].count() < 60
