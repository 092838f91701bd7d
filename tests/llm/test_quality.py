import random
import re

from vitalgrid.llm import quality


def counts(text):
    t = text or ""
    w = [x for x in re.split(r"[ \t-\r]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    clean = [". ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(rng.randint(4, 20))) + "." for _ in range(300)]
    junk = [" | ".join(rng.choice(words) for _ in range(60)) for _ in range(20)] + [" ".join(rng.choice(words).upper() + "!!" for _ in range(60)) for _ in range(20)]
    odd = [None, "", " \n\t", "a b c d e a b c d e", "x " * 30000, "é|é é\x0b# x\nq\nq\n q\n", "same line here\n" * 9]
    rows = list(enumerate(clean + junk + odd))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.verdicts(df).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        r, want = got[d], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert all(got[d].kept for d in range(300)) and not any(got[d].kept for d in range(300, 340))


def test_empty(spark):
    assert quality.verdicts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_posteriors_against_plain_em(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    texts = [". ".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(rng.randint(2, 12))) + rng.choice((".", "", " | | | #")) for _ in range(120)] + [" ".join(rng.choice(words).upper() + "!!|" for _ in range(60)) for _ in range(30)] + [None, "a b c"]
    rows = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    names = [r.name for r in quality.RULES]
    votes = [[r[f"vote_{n}"] for n in names] for r in rows]
    share, chance = quality.START_JUNK_SHARE, [list(quality.START_JUNK_VOTE) for _ in names]

    def clean(v):
        junk, good = share, 1 - share
        for x, (on_junk, on_clean) in zip(v, chance):
            junk *= {-1: on_junk, 1: 1 - on_junk, 0: 1.0}[x]
            good *= {-1: on_clean, 1: 1 - on_clean, 0: 1.0}[x]
        return good / (good + junk)

    for _ in range(quality.ROUNDS):
        p = [clean(v) for v in votes]
        k = quality.PRIOR_ROWS
        new_share = (sum(1 - x for x in p) + k * quality.START_JUNK_SHARE) / (len(p) + k)
        new = []
        for i in range(len(names)):
            both = []
            for of, start in ((lambda x: 1 - x, quality.START_JUNK_VOTE[0]), (lambda x: x, quality.START_JUNK_VOTE[1])):
                bad = sum(of(x) for x, v in zip(p, votes) if v[i] == -1)
                every = sum(of(x) for x, v in zip(p, votes) if v[i] != 0)
                both.append(min(max((bad + k * start) / (every + k), 1e-6), 1 - 1e-6))
            new.append(both)
        moved = max(abs(new_share - share), *(abs(a - b) for x, y in zip(new, chance) for a, b in zip(x, y)))
        share, chance = new_share, new
        if moved < 1e-5:
            break
    for r, v in zip(rows, votes):
        want = clean(v)
        assert abs(r.clean_probability - want) < 1e-6
        assert r.kept == (not r.base_failed and want >= 0.5)
    assert 10 < sum(r.kept for r in rows) < 140


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two three", 5, True, 0.5, "x")], "doc_id long, text string, n_words int, Kept boolean, clean_probability double, other string")
    row = quality.judge(df).first()
    assert (row.n_words, row.other, row.doc_id) == (3, "x", 1) and len(row.__fields__) == len({c.lower() for c in row.__fields__})
