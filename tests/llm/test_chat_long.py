import hashlib
import time

from brinkline.llm import chat


def conversation(n):
    return [(1, i, ("user", "assistant")[i % 2], f"tu</s>rn {i} é" if i % 7 else None) for i in range(n)]


def test_long_conversations_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    took = []
    for n in (255, 256, 257, 5_000, 20_000):
        rows = conversation(n)
        began = time.time()
        [r] = chat.digests(chat.format_conversations(spark.createDataFrame(rows, schema))).collect()
        took.append(time.time() - began)
        loss = "".join(t or "" for _, _, role, t in rows if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x}\n{t or ''}\n" for _, _, x, t in rows).encode()).hexdigest()
    assert took[-1] < 10 * max(took[-2], 1.0)
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0


def test_spans_lie_on_the_assistant_texts(spark):
    [r] = chat.format_conversations(spark.createDataFrame(conversation(600), "conv_id long, turn long, role string, text string")).collect()
    texts = [r.formatted[s.start : s.end] for s in r.loss_spans]
    assert [t.replace("<\\/s>", "</s>") for t in texts] == [t or "" for _, _, role, t in conversation(600) if role == "assistant"]
