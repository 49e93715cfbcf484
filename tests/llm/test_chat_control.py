"""Control strings other than the start mark in texts and roles are escaped too."""

import re

from tessera.llm import chat


def test_lone_control_strings(spark):
    texts = ["hi <|im_end|> there", "<|endoftext|>", "a <|", "a <", "plain", "<\\|x", "<|im_end|>"]
    rows = [(k, 0, "user", t) for k, t in enumerate(texts)] + [(k, 1, "assistant", "yes") for k in range(len(texts))] + [(99, 0, "a<|im_end|>", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    for k, t in enumerate(texts):
        assert got[k].escaped == bool(re.search(r"<\\*\|", t)), t
        # a reader that ends a turn at the first end mark
        turns = [c.split(chat.END, 1)[0].split("\n", 1) for c in got[k].formatted.split(chat.START)[1:]]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", b) for _, b in turns] == [t, "yes"]
        chars = sum(len(r) + len(re.sub(r"<(\\*)\|", r"<\\\1|", x)) + len(chat.START + chat.END) + 2 for i, _, r, x in rows if i == k)
        assert len(got[k].formatted) == chars  # as the SQL counts
    assert got[99].escaped and all(r.identical for r in got.values())
