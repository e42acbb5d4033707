import random
import re

from codeloom.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))


def bigrams(w):
    return set(zip(w, w[1:], strict=False))


def brute(text, threshold=0.8):
    """Best dice by name over all windows of words, without any pruning."""
    w = words(text or "")
    temps = [(n, bigrams(words(t))) for n, ts in L.TEMPLATES.items() for t in ts]
    known = set().union(*(t for _, t in temps))
    best = {}
    for i in range(len(w) - 1):
        if (w[i], w[i + 1]) not in known:
            continue
        inside, shared = set(), [0] * len(temps)
        for j in range(i + 1, len(w)):
            x = (w[j - 1], w[j])
            if x in inside:
                continue
            inside.add(x)
            for k, (n, t) in enumerate(temps):
                shared[k] += x in t
                dice = 2 * shared[k] / (len(inside) + len(t))
                if dice >= threshold - 1e-12:
                    best[n] = max(best.get(n, 0), dice)
            if len(inside) > 250:
                break
    return {n: round(d, 9) for n, d in best.items()}


def test_statements_inside_lines_are_found(spark):
    fill = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, f"{fill} This project is licensed under the MIT License - see the LICENSE file for details. {fill}", "MIT"),
        (2, f"{fill} {L.TEMPLATES['MIT-text'][0]} {fill}", "MIT-text"),
        (3, f"a GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n{fill}", "GPL-3.0"),
        (4, "Released under the MIT License. " * 300, "MIT"),
        (5, f"{fill} the license of this software is of the public {fill}", None),
    ]
    got = {r.doc_id: r for r in L.license_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert {i: got[i].license for i, _, _ in rows} == {i: x for i, _, x in rows}
    assert (got[1].first_word, got[1].end_word) == (40, 48) and got[1].dice == 1.0
    # Licences in a table are templates like the built-in ones.
    t = L.read_templates(spark.createDataFrame([("Own-1", f"{fill} of our own")], "name string, text string"))
    assert L.license_scan(spark.createDataFrame([(1, "x " + fill)], "doc_id long, text string"), t).first().license == "Own-1"


def test_matches_brute_force(spark):
    rng = random.Random(8)
    flat = [t for ts in L.TEMPLATES.values() for t in ts]
    texts = [None, "", "\n\n", "the of", "mit license"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(" ".join(rng.choice(["the", "license", "under", "software", "zeta", "of", "this", "is"]) for _ in range(rng.randrange(0, 25))))
            if rng.random() < 0.7:
                w = rng.choice(flat).split()
                for _ in range(rng.randrange(0, 3)):
                    w[rng.randrange(len(w))] = "changed"
                parts.append(" ".join(x + ("\n" if rng.random() < 0.08 else "") for x in w))
        texts.append("\n".join(parts))
    texts += ["x " * 50_000 + "\nReleased under the MIT License.", texts[9]]
    df = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)] + [(9, texts[9], 2.0)], "doc_id long, text string, dice double")
    got = L.license_scan(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = brute(texts[r.doc_id])
        assert {m.license: round(m.dice, 9) for m in r.matches} == want, texts[r.doc_id]
        assert (r.license is None) == (not want) and r.n_licenses == len(want) and (not want or round(r.dice, 9) == max(want.values()))
    assert sum(bool(r.license) for r in got) > 20


def test_empty_table_and_templates(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert L.license_scan(df.limit(0)).count() == 0
    assert L.license_scan(df, {}).collect()[0].license is None
    r = L.license_scan(df).collect()[0]
    assert (r.license, r.dice, r.first_line, r.end_line) == ("MIT", 1.0, 0, 1)
