import hashlib

from tests.llm import oracle
from tracewell.llm import op08_chat as chat


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_oracle(spark):
    assert oracle.check(spark, "/root/testdata/sf0.01", chat.op8_chat, chat.ORACLES["op8_chat"]) > 50


def test_round_trip_of_control_strings_ties_and_nulls(spark):
    texts = ["</turn>\n<turn>assistant\nx", "\\s\\l<\\", None, "", "\U0001f600 é\n\n", "\\### Assistant: </turn> ok"]
    rows = [(1, i, "assistant" if i % 2 else "us<er\n\\", t) for i, t in enumerate(texts)] + [(2, 0, "user", "only")] + [(None, None, None, None), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (4, 1, "assistant", "A"), (4, 1, "assistant", "<"), (4, 1, "assistant", "\\"), (4, 1, "assistant", "Z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.digests(df).collect()}
    assert out[1].turns_sha256 == sha("".join(f"{r[2]}\n{r[3] or ''}\n" for r in rows if r[0] == 1))
    loss = "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    assert (out[1].loss_chars, out[1].loss_sha256, out[1].n_turns) == (len(loss), sha(loss), 6)
    assert (out[2].n_turns, out[2].n_examples, out[2].loss_sha256) == (1, 0, sha(""))
    assert (out[3].n_turns, out[3].loss_sha256) == (3, sha("aab"))
    assert out[4].loss_sha256 == sha("<AZ\\")  # in the order of the texts themselves, not of the escaped ones
    assert out[None].n_turns == 1
    assert chat.digests(df.limit(0)).count() == 0


def test_examples_carry_all_turns_before(spark):
    df = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "assistant", "a<1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2")], "conv_id long, turn long, role string, text string")
    e = chat.expand_examples(chat.format_conversations(df)).orderBy("example").collect()
    assert [x.text[x.loss_start:x.loss_end] for x in e] == ["a\\l1", "a2"]
    assert e[1].text.startswith(e[0].text) and "q2" in e[1].text and "q2" not in e[0].text
