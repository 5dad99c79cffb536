"""Line rules against a plain version."""

import random
import re
from collections import Counter, defaultdict

from conceptmine.llm import line_rules


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(docs, share, least, left_share):
    base, lines = {}, {}
    for i, text, host in docs:
        w = words(text)
        runs = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        times = Counter(runs)
        marked = {k + j for k, r in enumerate(runs) if times[r] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        base[i] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked))
        lines[i] = [" ".join(words(re.sub("[A-Z]", lambda m: m[0].lower(), x))) for x in (text or "").split("\n")]
    texts = {(h, t or ""): i for i, t, h in docs}
    n_docs = Counter(h for h, _ in texts)
    have = defaultdict(set)
    for (h, _), i in texts.items():
        for x in lines[i]:
            if x:
                have[h, x].add(i)
    out = {}
    for i, _, h in docs:
        gone = sum(len(x.split(" ")) for x in lines[i] if x and len(have[h, x]) >= max(least, share * n_docs[h]))
        n, rep = base[i][0], base[i][4]
        failed = n < 50 or 100 * rep > 50 * n
        out[i] = (*base[i], failed, n - gone, not failed and n - gone >= left_share * n)
    return out


def test_equals_plain_version(spark):
    rnd = random.Random(3)
    pool = [" ".join(rnd.choice("ab Cc é# | x\tyy zzz q&".split(" ")) for _ in range(rnd.randrange(1, 30))) for _ in range(40)]
    docs = []
    for i in range(300):
        fresh = [" ".join(f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(0, 25))) for _ in range(rnd.randrange(0, 8))]
        body = fresh + rnd.sample(pool[:6] if i % 3 else pool, rnd.randrange(0, 5))
        rnd.shuffle(body)
        docs.append((i, rnd.choice(["\n", "\n\n", " \n"]).join(body), rnd.choice(["h1", "h1", "h2", None])))
    docs += [(1000, None, "h1"), (1001, "", None), (1002, " \n \n", "h2"), (1003, "word " * 30000, "h1"),
             (1004, docs[5][1], docs[5][2]), (1005, "\n".join(pool[:5]) * 9, "h1")]
    df = spark.createDataFrame([(i, t, h, 1) for i, t, h in docs], "doc_id long, text string, source string, n_words int")
    rows = line_rules.quality_report(df, share=0.1, least=5).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                      r.n_words_left, r.kept) for r in rows}
    want = plain(docs, 0.1, 5, 0.5)
    assert len(rows) == len(docs)
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}
    assert any(v[7] for v in want.values()) and any(v[6] < v[0] for v in want.values())


def test_removal_and_empty_table(spark):
    body = " ".join(f"w{i}" for i in range(60))
    docs = [(i, f"\nheader line\n\n{body} {i}\nheader line", "h") for i in range(12)] + [(99, None, "h")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in line_rules.remove_lines(df, line_rules.quality_report(df)).collect()}
    assert out == {i: f"{body} {i}" for i in range(12)}
    assert line_rules.quality_report(df.where("false")).count() == 0
    twice = df.where("doc_id = 1").union(df.where("doc_id = 1"))
    assert line_rules.quality_report(twice).count() == 2
