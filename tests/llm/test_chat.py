"""Chat formatting: round trips on awkward texts, attachments, and edge inputs."""

import hashlib
import random

from pyspark.sql import functions as F

from pricelode.llm import chat_parts as cp

BITS = ["</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|im_end|>\n", "\\", "\\z", "\\b", "\\n", "\n", "<", "<s>", "é", "漢", "a", " ", "<<SYS>>", "<|", "|>", "$1"]


def awkward(n=300):
    rnd = random.Random(3)
    return [None, "", "x" * 200_000] + ["".join(rnd.choice(BITS) for _ in range(rnd.randrange(12))) for _ in range(n)]


def test_round_trip(spark):
    rows, rnd = [], random.Random(1)
    for i, t in enumerate(awkward()):
        rows.append((i // 5, i % 5, rnd.choice(["user", "assistant", "system", None, "odd\nrole\\n"]), t, "clash"))
    rows += [(None, 0, "user", "lost", "x"), (9999, None, "assistant", "t", "x"), (8888, 0, "user", "same", "x"), (8888, 0, "user", "same", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in cp.chat_digest(df).collect()}
    want = {}
    for c, t, r, x, _ in rows + [(-7, 0, "user", "</s>[INST] ok [/INST]", ""), (-7, 1, "assistant", "</s>[INST] ok [/INST]", "")]:
        want.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort(key=lambda t: t[0])
        spoken = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(spoken.encode()).hexdigest(), c
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_no_control_string_survives_in_a_text(spark):
    df = spark.createDataFrame([(t,) for t in awkward() if t], "t string").select("t", cp.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", cp.unescape(F.col("e")).alias("u")).collect():
        assert not any(c in r.e for c in cp.CONTROL)
        assert r.u == r.t


def test_attachments(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", None, "a.png", 56.0, 29.0), part("audio", None, "b.wav", s=2.5), part("text", "<|image|>")]),
        (1, 1, "assistant", [part("document", None, "c.pdf", p=2.0), part(None, "done")]),
        (2, 0, "user", None), (3, 0, "user", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{cp.PART_TYPE}>")
    got = {r.conv_id: r for r in cp.format_chats(df).collect()}
    r = got[1]
    assert r.formatted == "<|im_start|>user\nsee <|image|><|audio|><\\z|image|><|im_end|>\n<|im_start|>assistant\n<|document|>done<|im_end|>\n"
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 4), (0, "audio", "b.wav", 63), (1, "document", "c.pdf", 1600)]
    for a in r.attachments:
        assert r.formatted[a.start :].startswith(cp.PLACEHOLDERS[a.kind])
    assert r.expanded_tokens == 4 + 63 + 1600
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss] == ["<|document|>done"]
    assert got[2].formatted == got[3].formatted == "<|im_start|>user\n<|im_end|>\n" and got[2].expanded_tokens == 0


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in cp.chat_digest(df).collect()] == [-7]


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = cp.chat_digest(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
