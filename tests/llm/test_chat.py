from tidemark.llm.chat import digest, neighbours, preferences


def r(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def test_pairs(spark):
    rows = [
        (1, "chosen", 0, "user", "Hi"), (1, "chosen", 1, "assistant", "Yes é"), (1, "chosen", 2, "user", "so"), (1, "chosen", 3, "assistant", "ok"),
        (1, "rejected", 1, "assistant", "Yes é"), (1, "rejected", 0, "user", "Hi"), (1, "rejected", 2, "user", "no"),
        (2, "chosen", 0, "user", "a"), (2, "rejected", 0, "assistant", "a"),
        (3, "chosen", 0, "user", None), (3, "rejected", 0, "user", ""),
        (4, "chosen", 0, "assistant", "alone"), (None, "chosen", 0, "user", "x"), (5, "other", 0, "user", "x"),
    ]
    df = spark.createDataFrame([(*x, 9) for x in rows], "pair_id long, side string, turn long, role string, text string, prompt int").repartition(4)
    got = {g.pair_id: tuple(g)[1:] for g in digest(preferences(df)).collect()}
    assert got == {
        1: (2, r("user", "Hi") + r("assistant", "Yes é"), r("user", "so") + r("assistant", "ok"), r("user", "no"), f"{len(r('user', 'so')) + 14}:{len(r('user', 'so')) + len(r('assistant', 'ok'))}", ""),
        2: (0, "", r("user", "a"), r("assistant", "a"), "", f"14:{len(r('assistant', 'a'))}"),
        3: (1, r("user", ""), "", "", "", ""),
        4: (0, "", r("assistant", "alone"), "", f"14:{len(r('assistant', 'alone'))}", ""),
    }
    assert digest(preferences(df.limit(0))).collect() == []


def test_every_turn_of_the_table_comes_back(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {0 if t < 2 else c}-{t}") for c in range(10) for t in range(4)]
    got = preferences(neighbours(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert len(got) == 5
    assert all(g.n_prompt_turns == 2 and g.prompt.count("<|end|>") == 2 and g.chosen.count("<|end|>") == 2 for g in got)


def test_large_ids_and_ties(spark):
    big = 1 << 60
    turns = [(big + k, t, "user", f"{k}{t}") for k in range(4) for t in (0, 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert sorted(r.pair_id for r in preferences(neighbours(df)).collect()) == [big >> 1, (big >> 1) + 1]
    tied = spark.createDataFrame([(0, 1, "user", "b"), (0, 1, "user", "a"), (0, None, "user", "z"), (0, 1, "user", "a"), (1, 5, "assistant", "x" * 100_000)], df.schema)
    row = preferences(neighbours(tied)).first()
    assert row.prompt == "" and row.chosen == "".join(f"<|user|>\n{x}<|end|>\n" for x in "zaab") and row.rejected.count("x") == 100_000
    long = spark.createDataFrame([(c, t, "user", str(t)) for c in (0, 1) for t in range(3000)] + [(1, 3000, "assistant", "end")], df.schema)
    row = preferences(neighbours(long)).first()
    assert (row.n_prompt_turns, row.chosen, row.rejected) == (3000, "", "<|assistant|>\nend<|end|>\n")
