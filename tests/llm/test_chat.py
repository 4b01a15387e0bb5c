import hashlib
import random

import pytest

from tidemark.llm import chat as C


@pytest.mark.parametrize("text", ["", "\\", "\\h", "### ", "#### ", "\\### x</turn>", "</turn></turn", "\\\\l<", "### Assistant: ok", "é😀 <|endoftext|>\n"])
def test_escape(text):
    assert C.unescape(C.escape(text)) == text and "### " not in C.escape(text) and "</turn>" not in C.escape(text)


def test_turns_come_back():
    r = random.Random(1)
    parts = ["### ", "</turn>", "\\", "h", "l", ": ", "Assistant", "é", "\n", "x", "😀", "<|endoftext|>"]
    roles = [r.choice(["user", "assistant", "system", "tool", "", "a: ### b"]) for _ in range(300)]
    texts = ["".join(r.choices(parts, k=r.randint(0, 9))) for _ in roles]
    path = C.tokenizer_path()
    for role, text, (ids, mask) in zip(roles, texts, C.encode_turns(roles, texts, path), strict=True):
        formatted, a, b, loss = C.read_back(ids, mask, path)
        assert (a, b, loss) == (role, text, text if role == "assistant" else "")
        assert formatted.count("</turn>") == 1 and formatted.count("### ") == 1 and sum(i >= C.RESERVED for i in ids) <= 3


def test_digest(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (2, 0, "assistant", None, 0), (3, 0, None, "q", 1), (4, 5, "user", "t", 1), (4, 5, "user", "t", 1), (4, 5, "assistant", "s", 1), (None, None, "user", "z", 1)]
    got = {r.conv_id: r for r in C.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1][1:] == (2, sha("user\na\nassistant\nb\n"), 1, sha("b"), len("### User: a</turn>### Assistant: b</turn>"))
    assert got[2][1:5] == (1, sha("assistant\n\n"), 0, sha("")) and got[3].turns_sha256 == sha("\nq\n")
    assert got[4][1:4] == (3, sha("assistant\ns\nuser\nt\nuser\nt\n"), 1) and got[None].n_turns == 1
    assert got[-7].loss_sha256 == sha(C.TRAP) and got[-7].loss_chars == len(C.TRAP) and len(got) == 6
    starts = sorted((r.turn, r.start) for r in C.with_offsets(C.turns(spark.createDataFrame(rows[:2], "conv_id long, turn long, role string, text string, x int"))).collect())
    assert starts == [(0, 0), (1, 3)]
