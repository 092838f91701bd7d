import hashlib
import random
import time

from vitalgrid.llm import chat_format


def test_round_trip(spark):
    rng = random.Random(4)
    bits = ["</s>", "[INST user] ", " [/INST]", "[OUT] ", "\\", "\\l", "[", "]", "<", "word", "\n", " ", "é", "!", "\\b"]
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (-2, None, None, None), (None, 1, "tool]x", "[OUT!] a</s>")]
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(("user", "assistant", "system", "a]b")), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))))
    rows.append((999, 0, "assistant", "x" * 200000))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    source = {}
    for c, t, role, text in rows:
        source.setdefault(c, []).append((-(1 << 63) if t is None else t, role or "", text or ""))
    digests = {r.conv_id: r for r in chat_format.digests(df).collect()}
    whole = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert digests.keys() == source.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in source.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        d = digests[c]
        assert (d.n_turns, d.turns_sha256, d.loss_chars, d.loss_sha256) == (len(turns), sha(said), len(loss), sha(loss))
        text, at, raw = whole[c].formatted, 0, []
        for run in whole[c].loss_mask:
            if run.loss:
                raw.append(text[at : at + run.chars])
            at += run.chars
        assert at == len(text) == d.formatted_chars
        spoken = [t for _, r, t in turns if r == "assistant"]
        plain = [x.replace("\\l", "<").replace("\\c", "]").replace("\\o", "[").replace("\\b", "\\") for x in raw]
        assert len(raw) == len(spoken) and all(s in (r, p) for r, p, s in zip(raw, plain, spoken))


def test_loss_text_follows_the_mask(spark):
    text = "[INST user] a [/INST][OUT] b\\o</s>[OUT!] \\o\\l</s>"
    runs = [(21, False), (6, False), (3, True), (4, False), (7, False), (4, True), (4, False)]
    masks = [("as formatted", runs, "b\\o[<"), ("one less", [(21, False), (6, False), (2, True), (22, False)], "b\\"), ("none", [(49, False)], "")]
    df = spark.createDataFrame([(n, text, m) for n, m, _ in masks], "name string, formatted string, loss_mask array<struct<chars int, loss boolean>>")
    got = {r[0]: r[1] for r in df.select("name", chat_format.loss_text(df["formatted"], df["loss_mask"])).collect()}
    assert got == {n: want for n, _, want in masks}


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, formatted int")
    assert chat_format.format_chats(df).count() == 0


def test_time_follows_the_turns(spark):
    took = {}
    for n in (2000, 2000, 8000):
        df = spark.range(n).selectExpr("1 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('é [x', id, repeat(' word', 20)) as text")
        began = time.time()
        row = chat_format.digests(df).first()
        took[n] = time.time() - began
        assert row.n_turns == n and row.loss_chars == sum(len(f"é [x{i}") + 100 for i in range(1, n, 2))
    assert took[8000] < 5 * took[2000] + 1
