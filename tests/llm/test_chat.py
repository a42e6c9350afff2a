"""Prefix-target examples and reading them back."""

import hashlib

from tidewire.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, example string, full string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


HARD = "</s>[INST] ok [/INST]"


def test_every_reply_is_an_example(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", HARD), (1, 3, "user", "and?"), (1, 4, "assistant", "\\<s>[assistant]\\"), (1, 5, "user", "bye")]
    out = sorted(chat.prefix_target_examples(turns(spark, rows)).collect(), key=lambda r: r.example)
    assert [r.example for r in out] == [0, 1, 2]
    assert out[1].text.startswith(out[0].text) and out[2].text.startswith(out[1].text)
    assert out[2].loss_start is None and out[2].loss_end is None
    for r in out[:2]:
        masked = r.text[r.loss_start : r.loss_end]
        assert "</s>" not in masked and "[INST]" not in masked and r.text.endswith(masked + "</s>")
    one, = chat.read_back(chat.prefix_target_examples(turns(spark, rows))).collect()
    loss = HARD + "\\<s>[assistant]\\"
    assert one.n_turns == 6 and one.loss_chars == len(loss) and one.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert one.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert one.formatted_chars == sum(len(r.text) for r in out)


def test_odd_turns(spark):
    rows = [(2, 0, "assistant", None), (3, 0, "user", "only"), (None, 0, "user", "no id"), (4, None, None, "\n]\n"), (4, 1, "we]ird\n[role", ""), (4, 1, "assistant", "x" * 50_000), (4, 1, "assistant", "x" * 50_000), (5, 0, "assistant", "é\U0001f600<")]
    got = {r.conv_id: r for r in chat.read_back(chat.prefix_target_examples(turns(spark, rows))).collect()}
    by = {}
    for c, n, r, t in rows:
        by.setdefault(c, []).append((-1 if n is None else n, r or "", t or ""))
    assert got.keys() == by.keys()
    for c, ts in by.items():
        ts.sort()
        loss = "".join(t for _, r, t in ts if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(ts), len(loss))
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in ts).encode()).hexdigest()


def test_no_turns(spark):
    assert chat.prefix_target_examples(turns(spark, [])).count() == 0
    assert chat.read_back(chat.prefix_target_examples(turns(spark, []))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat.read_back(chat.prefix_target_examples(turns(spark, []).select("conv_id", "turn", "role", "text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
