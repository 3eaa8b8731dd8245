import random

import numpy as np

from matchloom.llm.leaks import BITS, find_leaks, passage, plain_words, simhash_runs, word_hash

VOCABULARY = [f"w{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghij"]
INSTRUCTION = "Choose the best answer and explain your choice briefly."


def brute(doc, item):
    """Longest aligned passage of at least 20 words, one in eight altered, both ends alike."""
    d, w, best = plain_words(doc), plain_words(item), None
    for shift in range(-len(w), len(d)):
        same = [0 <= i + shift < len(d) and d[i + shift] == w[i] for i in range(len(w))]
        for i in range(len(w)):
            for j in range(i + 20, len(w) + 1):
                if i + shift >= 0 and j + shift <= len(d) and same[i] and same[j - 1]:
                    bad = same[i:j].count(False)
                    if bad * 8 <= j - i and (best is None or j - i > best):
                        best = j - i
    return best


def test_against_brute_force(spark):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n))
    items = [(k, (INSTRUCTION + " " if k < 8 else "") + text(r.choice([12, 19, 20, 35, 60]))) for k in range(24)]
    docs = [(0, ""), (1, None), (2, INSTRUCTION + " " + text(40))]
    for i in range(3, 160):
        words = plain_words(items[r.randrange(24)][1].replace(INSTRUCTION, ""))
        n = r.choice([15, 18, 20, 22, 30, 60])
        a = r.randrange(max(1, len(words) - n + 1))
        part = words[a : a + n]
        for _ in range(int(len(part) * r.choice([0, 0.05, 0.12, 0.2]))):
            part[r.randrange(len(part))] = r.choice(VOCABULARY)
        docs.append((i, f"{text(r.randrange(30))} {' '.join(part)} {text(r.randrange(30))}"))
    d = spark.createDataFrame([*docs, docs[5]], "doc_id bigint, text string")
    q = spark.createDataFrame([*items, items[0], (99, None), (98, "")], "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]): x["n_words"] for x in find_leaks(d, q).collect()}
    want = {}
    for i, t in docs:
        for k, w in items:
            best = brute(t, w.replace(INSTRUCTION, ""))
            if best:
                want[i, k] = best
    assert got == want and len(want) > 30


def test_form_does_not_matter(spark):
    words = [VOCABULARY[i] for i in range(25)]
    plain = " ".join(words)
    forms = [plain.upper(), ", ".join(words), "> " + "\n> ".join(words), "<b>" + "</b> <b>".join(words) + "</b>", "&nbsp;".join(words), " ".join(w[0] + "­" + w[1:] for w in words), "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in plain), "lead " * 3000 + plain]
    d = spark.createDataFrame(list(enumerate(forms)), "doc_id bigint, text string")
    q = spark.createDataFrame([(1, plain)], "item_id bigint, text string")
    assert {(x["doc_id"], x["n_words"], x["n_altered"]) for x in find_leaks(d, q).collect()} == {(i, 25, 0) for i in range(len(forms))}
    assert find_leaks(d.limit(0), q).count() == 0 and find_leaks(d, q.limit(0)).count() == 0


def test_many_items_go_in_blocks(spark, monkeypatch):
    from matchloom.llm import leaks

    monkeypatch.setattr(leaks, "BLOCK_WORDS", 30)
    items = [(k, " ".join(VOCABULARY[k * 25 : k * 25 + 25])) for k in range(6)]
    d = spark.createDataFrame([(1, " ".join(t for _, t in items))], "doc_id bigint, text string")
    assert find_leaks(d, spark.createDataFrame(items, "item_id bigint, text string")).count() == 6
    assert find_leaks(d.withColumn("doc_id", d["doc_id"].cast("int")), spark.createDataFrame([(str(k), t) for k, t in items], "item_id string, text string")).count() == 6


def test_simhash_of_a_run_is_the_majority():
    h = np.array([word_hash(w) for w in VOCABULARY[:30]], np.uint64)
    for length in (6, 7):
        got = simhash_runs(h, length)
        assert len(got) == 30 - length + 1
        for i in (0, 5, len(got) - 1):
            want = sum(1 << b for b in range(BITS) if 2 * sum(int(x) >> b & 1 for x in h[i : i + length]) > length)
            assert int(got[i]) == want
    assert passage(h[:10], h[:10]) is None
