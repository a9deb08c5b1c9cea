import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import written
from tracewarden.llm import chat_format as chat
from tracewarden.llm.queries import CONTROLS, QUERIES

TURNS = "conv_id long, turn long, role string, text string, position long"
ODD = [
    (1, 1, "assistant", "b \\ <part:image:0> </turn>\n<turn:user>x", None),
    (1, 0, "user", "####\\\\", 4),
    (1, 2, None, None, None),
    (1, None, "sys>tem\\<", "first", None),
    (2, 0, "assistant", "same", None),
    (2, 0, "assistant", "same", None),
    (None, 0, "user", "no conversation é🙂\n", None),
    (3, 5, "assistant", "", None),
    (4, 0, "assistant", "<turn:" * 20_000, None),
]


def expected(rows):
    groups = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        groups[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    for conv_id, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        text = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        yield conv_id, len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_odd_rows_read_back(spark):
    got = chat.conversation_digests(chat.format_turns(spark.createDataFrame(ODD, TURNS).repartition(3))).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected(ODD), key=str)
    assert chat.conversation_digests(chat.format_turns(spark.createDataFrame([], TURNS))).count() == 0


def test_query_adds_the_control_conversation(spark, tmp_path):
    sf = written(spark, tmp_path, conversations=spark.createDataFrame(ODD, TURNS))
    got = QUERIES["op1_chat_format"](spark, sf).collect()
    rows = [*ODD, (-7, 0, "user", CONTROLS), (-7, 1, "assistant", CONTROLS)]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected(rows), key=str)


def test_escape_is_reversible_and_hides_controls():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["\\", "<", "<turn:", "</turn>", "\n", ">", "<part:", "image:0>", "a", "###"]) for _ in range(rng.randrange(9)))
        assert chat.unescape(chat.escape(text)) == text
        formatted = f"<turn:user>{chat.escape(text)}</turn>\n" * 2
        assert chat.read_formatted(formatted) == [("user", text, [])] * 2


@pytest.mark.parametrize("broken", ["x", "<turn:user>", "</turn>\n", "<turn:a><turn:b></turn>\n", "\\<turn:a></turn>\n"])
def test_broken_text_is_an_error(broken):
    with pytest.raises(ValueError):
        chat.read_formatted(broken)


def test_parts_become_ordered_placeholders(spark):
    part = dict(text=None, ref=None, width=None, height=None, seconds=None, pages=None)
    turns = [
        (1, 0, "user", [part | {"type": "text", "text": "see <part: "}, part | {"type": "image", "ref": "a.png", "width": 1024, "height": 513}, part | {"type": None, "text": "end"}]),
        (1, 1, "assistant", [part | {"type": "text", "text": "one"}, part | {"type": "audio", "ref": "b.wav", "seconds": 1.5}, part | {"type": "text", "text": "two\\"}]),
        (1, 2, "user", [part | {"type": "document", "ref": "c.pdf", "pages": 3}, part | {"type": "odd kind"}]),
        (1, 3, "user", None),
    ]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, content array<{chat.PART_TYPE}>")
    rows = chat.format_turns(df, content=F.col("content")).orderBy("position").collect()
    text = "".join(r["segment"] for r in rows)
    assert [len("".join(r["segment"] for r in rows[:i])) for i in range(4)] == [r["start"] for r in rows]
    marks = [(a["kind"], a["number"], a["ref"], a["tokens"]) for r in rows for a in r["attachments"]]
    assert marks == [("image", 0, "a.png", 85 + 170 * 4), ("audio", 1, "b.wav", 38), ("document", 2, "c.pdf", 3072), ("odd_kind", 3, None, 0)]
    for r in rows:
        for a in r["attachments"]:
            assert text[a["at"] :].startswith(f"<part:{a['kind']}:{a['number']}>")
    assert chat.read_formatted(text) == [
        ("user", "see <part: end", [("image", 0)]),
        ("assistant", "onetwo\\", [("audio", 1)]),
        ("user", "", [("document", 2), ("odd_kind", 3)]),
        ("user", "", []),
    ]
    loss = [chat.unescape(text[s["start"] : s["start"] + s["length"]]) for r in rows for s in r["loss"]]
    assert loss == ["one", "two\\"] and rows[2]["attachment_tokens"] == 3072
