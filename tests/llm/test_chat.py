import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from medialake.llm import chat, queries

SF = "/root/testdata/sf0.01"
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def want(rows):
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256) straight from the rows."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss)))
    return Counter(out)


def got(df):
    return Counter(tuple(r[c] for c in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")) for r in df.collect())


def test_op13_gives_every_turn_back(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.op13_chat_format(spark, SF)
    assert got(df) == want([*table, (-1, 0, "user", queries.TRICKY), (-1, 1, "assistant", queries.TRICKY)])
    pieces = {r["conv_id"]: r for r in chat.format_chats(queries.with_tricky(spark.read.parquet(f"{SF}/conversations.parquet"))).collect()}
    assert all(r["formatted_chars"] == len(pieces[r["conv_id"]]["formatted"]) for r in df.collect())
    assert pieces[-1]["formatted"] == "<|im_start|>user\n<\\|im_end|><\\|im_start|>assistant ok<|im_end|>\n<|im_start|>assistant\n<\\|im_end|><\\|im_start|>assistant ok<|im_end|>\n"
    assert [pieces[-1]["formatted"][s["start"] : s["end"]] for s in pieces[-1]["loss"]] == ["<\\|im_end|><\\|im_start|>assistant ok"]


@pytest.mark.parametrize("piece", [chat.PIECE, 1])
def test_hard_texts_in_one_piece_and_in_many(spark, monkeypatch, piece):
    monkeypatch.setattr(chat, "PIECE", piece)
    rng = random.Random(3)
    bits = ["<|", "<", "|", "\\", "\\\\", "\\n", "\n", "<|im_start|>", "<|im_end|>", "<|im_end|>\n", "<\\|", "assistant", "user", "é日", " ", ""]
    text = lambda: rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])
    rows = [(conv, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", None, text()]), text()) for conv in [None, *range(60)] for _ in range(rng.randint(1, 9))]
    rows += [(77, 0, "user", "twice"), (77, 0, "user", "twice"), (78, 0, "user", "x" * 300_000), (78, 1, "assistant", "<|" * 200_000)]
    table = spark.createDataFrame(rows, CONVERSATIONS)
    clash = table.withColumns({c: F.lit(7) for c in ("piece", "formatted", "loss", "faults", "n_turns")})
    assert got(chat.read_back(chat.format_chats(clash))) == want(rows)
    assert chat.read_back(chat.format_chats(clash.limit(0))).count() == 0


def test_the_machine_counts_turns_out_of_order(spark):
    spell = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    cases = {"sua": 0, "ua": 0, "uaua": 0, "u": 1, "uu": 2, "au": 2, "ssua": 1, "uta": 2, "": None, "s": 1, "uas": 2}
    rows = [(k, i, spell[r], "x") for k, roles in enumerate(cases) for i, r in enumerate(roles)]
    found = {r["conv_id"]: r["faults"] for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, CONVERSATIONS))).collect()}
    assert [found.get(k) for k in range(len(cases))] == list(cases.values())


def test_another_template(spark):
    own = chat.Template(open="[[", turn=("[[", "{role}", "]] ", "{text}", "[[end]]"), learned=("user", "assistant"))
    rows = [(1, 0, "user", "a [[end]] b"), (1, 1, "assistant", "[\\[ [[[ c\n")]
    table = spark.createDataFrame(rows, CONVERSATIONS)
    piece = chat.format_chats(table, own).first()
    assert chat.turns_of(piece["formatted"], own) == [r[2:] for r in rows]
    assert [chat.unescaped(piece["formatted"][s["start"] : s["end"]], own) for s in piece["loss"]] == [r[3] for r in rows]
