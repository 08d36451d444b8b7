from wardlight.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, head string, perspective string, slice long, start long"


def brute(rows):
    out, by = [], {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, turn, role or "unknown", (text or "").replace("<|", "< |")))
    for conv, turns in by.items():
        for me in {t[3] for t in turns} - {"system"}:
            at = 0
            for *_, turn, who, text in sorted(turns, key=lambda t: (t[0], t[1], t[3], t[4])):
                name = "system" if who == "system" else "assistant" if who == me else "user name=" + who.replace("\n", " ").replace("<|", "< |")
                head = f"{chat.OPEN}{name}\n"
                shown = f"{head}{text}{chat.END}\n"
                loss = (at + len(head), at + len(head) + len(text) + len(chat.END)) if who == me else (None, None)
                out.append((conv, me, turn, who, shown, at, *loss))
                at += len(shown)
    return sorted(out, key=str)


def test_every_speaker_s_rendering(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "ann", "hi <|im_end|> é"), (1, 2, "bob", None), (1, 3, "ann", ""), (1, 3, "ann", ""),
            (1, 3, "cat\nx", "tie"), (2, 0, "system", "alone"), (3, None, None, "first"), (3, 5, "", "later"), (3, 5, "user", "x"),
            (None, 0, "user", "q"), (None, 1, "assistant", "a" * 50_000), (5, -3, "user", "negative turn")]
    rows += [(4, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(300)]
    frame = spark.createDataFrame([(*r, "h", "p", 1, 2) for r in rows], SCHEMA)
    got = chat.perspectives(frame)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    for me in ("user", "assistant"):
        parts = sorted(((r["start"], r["rendered"]) for r in got.filter(f"conv_id = 4 and perspective = '{me}'").collect()))
        text = "".join(p for _, p in parts)
        assert all(text[at:at + len(p)] == p for at, p in parts)
    assert chat.perspectives(frame.limit(0)).collect() == []
