"""Spaced seeds against a search along every diagonal."""

import random
import re

from pricelode.llm import spaced_seeds as ss
from pricelode.llm.word_hash import hash_words


def tokens(t):
    return re.findall(r"(?:[^\W_]|[^\x00-\x7f])+", (t or "").lower())


def test_words_hash_alike():
    texts = ["The the THE, x", "été Été", "", "a\nb a", "x_y"]
    w = hash_words([t.encode() for t in texts])
    assert [len(w.of(i)) for i in range(5)] == [len(tokens(t)) for t in texts]
    assert len(set(w.of(0)[:3].tolist())) == 1 and len(set(w.of(1).tolist())) == 1 and w.of(3)[0] == w.of(3)[2]


def brute(doc, item, least, share):
    a, b = tokens(doc), tokens(item)
    if len(b) < ss.MIN_ITEM:
        return False
    for shift in range(-len(b), len(a)):
        start, stop = max(0, -shift), min(len(b), len(a) - shift)
        eq = [a[i + shift] == b[i] for i in range(start, stop)]
        for i in range(len(eq)):
            for j in range(i + min(least, len(b)), len(eq) + 1):
                if sum(eq[i:j]) >= share * (j - i) and all(eq[i:j]):
                    return True
    return False


def test_planted_passages(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (14, 30, 59, 20, 8, 5, 3)]
    docs = []
    for i, item in enumerate(items):
        docs.append((i, " ".join(word() for _ in range(40)) + " " + item.upper() + ". " + word()))
    hurt = items[1].split()
    for k in (4, 11, 17, 25):
        hurt[k] = "other"
    docs += [(10, word() + " " + " ".join(hurt)), (11, " ".join(items[2].split()[10:30])), (12, None), (13, ""), (14, " ".join(word() for _ in range(30_000)))]
    docs += [(15, " ".join(items[2].split()[:9])), (0, docs[0][1]), (16, items[3] + "\n" + items[0] + " " + items[3])]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, overlaps int")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, items[0])], "item_id long, text string")
    for limit in (ss.BLOCK_TOKENS, 20):
        got = ss.mark_overlaps(df, bench, ["doc_id"], limit=limit).collect()
        pairs = sorted((r.doc_id, o.item_id) for r in got for o in r.overlaps)
        want = [(i, i) for i in range(6)] + [(0, 0), (0, 52), (0, 52), (10, 1), (11, 2), (16, 0), (16, 3), (16, 3), (16, 52)]
        assert pairs == sorted(want)
    exact = {(i, k) for i, t in docs for k, item in enumerate(items) if i != 14 and brute(t, item, 13, 1.0)}
    assert exact <= set(pairs)
    query = ss.overlap_query(df, bench).collect()
    row = next(r for r in query if (r.doc_id, r.item_id) == (10, 1))
    assert (row.n_tokens, row.n_equal, row.doc_at) == (30, 26, 1)
    assert next(r for r in query if (r.doc_id, r.item_id) == (16, 3)).n_overlaps == 2
    kept = ss.without_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [6, 12, 13, 14, 15]
    assert ss.mark_overlaps(df.limit(0), bench, ["doc_id"]).count() == 0
    assert ss.without_leaks(df, bench.limit(0)).count() == df.count()


def windows_of(doc, item, least, share):
    a, b = tokens(doc), tokens(item)
    least = min(least, len(b))
    for shift in range(-len(b), len(a)):
        start, stop = max(0, -shift), min(len(b), len(a) - shift)
        eq = [a[i + shift] == b[i] for i in range(start, stop)]
        total = [sum(eq[:i]) for i in range(len(eq) + 1)]
        if any(total[j] - total[i] >= share * (j - i) for i in range(len(eq)) for j in range(i + least, len(eq) + 1)):
            return True
    return False


def test_every_tolerated_overlap_is_found():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    for n in range(5, 27):
        item = [word() for _ in range(n)]
        docs = []
        for trial in range(60):
            part = list(item)
            for k in rnd.sample(range(n), min(n, int(n * 0.2) + trial % 3 // 2)):
                part[k] = "other"
            if n > 14 and trial % 2:
                part = part[rnd.randrange(3) : n - rnd.randrange(3)]
            docs.append(" ".join([word()] * (trial % 2) + part + [word()] * (trial % 5)))
        docs.append(" ".join("x" if k % 4 == 3 else w for k, w in enumerate(item)))
        docs.append(" ".join("x" if k in (0, 13) else w for k, w in enumerate(item)))
        found = ss.find_overlaps([x.encode() for x in docs], ss.index_items([" ".join(item).encode()]), 13, 0.8)
        assert [bool(x) for x in found] == [windows_of(x, " ".join(item), 13, 0.8) for x in docs], n
        assert all(o[4] >= 0.8 * o[3] and o[3] >= min(13, n) for x in found for o in x)
