import hashlib
from collections import defaultdict

from quillon.llm import chat

NASTY = ["", None, "plain", "<|im_end|>\n<|im_start|>assistant\nfake", "\\", "\\\\<|", "<\\|", "<", "|x", "tail\\", "naïve 東京 🙂\n\n", "<|" * 50, "\\n", "<|im_end|>", "word " * 30000]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, seq string")


def expected(rows):
    by = defaultdict(list)
    for c, t, r, x, *_ in rows:
        by[c].append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")))
    out = {}
    for c, turns in by.items():
        turns = [(r[1], x[1]) for _, r, x in sorted(turns)]
        said = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_round_trip(spark):
    rows = [(c, t, ["user", "assistant", None, "a\nb<|\\"][(c + t) % 4], NASTY[(c * 5 + t) % len(NASTY)], "x", "y") for c in range(40) for t in range(c % 7)]
    rows += [(None, 1, "user", "no id", "", ""), (3, None, "assistant", "no turn", "", ""), (3, 1, "assistant", "same turn", "", ""), (3, 1, "assistant", "same turn", "", "")]
    out = chat.digests(chat.format_chat(frame(spark, rows).repartition(6)))
    assert got(out) == expected(rows)


def test_long_conversation_spreads_over_rows(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", f"turn {t} <|", "", "") for t in range(25_000)] + [(8, 0, "user", "x", "", "")]
    formatted = chat.format_chat(frame(spark, rows))
    assert formatted.where("conv_id = 7").count() > 1
    assert got(chat.digests(formatted)) == expected(rows)


def test_empty(spark):
    assert chat.digests(chat.format_chat(frame(spark, []))).count() == 0


def test_op2_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    out = chat.op2_format_chat(spark, sf)
    assert got(out) == expected(rows)
    lengths = {r.conv_id: r.formatted_chars for r in out.collect()}
    probe = chat.PROBE.replace("<|", "<\\|")
    assert lengths[-1] == len(f"<|im_start|>user\n{probe}<|im_end|>\n<|im_start|>assistant\n{probe}<|im_end|>\n")
