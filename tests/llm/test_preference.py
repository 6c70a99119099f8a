from threadgraph.llm import preference as p


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def masked(turns):
    out = []
    for r, t in turns:
        head, body = len(f"<|im_start|>{r}\n"), len(f"{t}<|im_end|>\n")
        out.append(f"0:{head},1:{body}" if r == "assistant" else f"0:{head + body}")
    return ",".join(out)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role, text))
    key = lambda t: tuple((x is not None, x) for x in (t[0], t[1] or "unknown", t[2] or ""))
    convs = {c: [(r or "unknown", t or "") for _, r, t in sorted(v, key=key)] for c, v in convs.items()}
    last = {c: max((k for k, (r, _) in enumerate(v) if r == "assistant"), default=None) for c, v in convs.items()}
    out = {}
    for c, turns in convs.items():
        other = None if c is None else c ^ 1
        if c is None or other not in convs or last[c] is None or last[other] is None:
            out[c] = ("unpaired", len(turns), render(turns), None, None, None, None)
            continue
        rejected = [convs[other][last[other]] if k == last[c] else t for k, t in enumerate(turns)]
        n = next((k for k in range(len(turns)) if turns[k] != rejected[k]), len(turns))
        out[c] = ("identical" if n == len(turns) else "paired", n, render(turns[:n]), render(turns[n:]), masked(turns[n:]), render(rejected[n:]), masked(rejected[n:]))
    return out


def test_pairs(spark):
    u, a = "user", "assistant"
    rows = [(0, 0, u, "hi"), (0, 1, a, "x🙂"), (0, 2, u, "and?"), (0, 3, a, "long answer"), (0, 4, u, "bye"), (1, 0, u, "q"), (1, 1, a, "other")]
    rows += [(2, 0, u, "solo"), (2, 1, a, None), (4, 0, u, "no answer"), (5, 0, a, "x"), (6, 0, a, "same"), (7, 0, a, "same"), (8, None, None, None), (8, 1, a, "z"), (9, 1, a, "z2"), (9, 1, a, "z2")]
    rows += [(None, 0, u, "lost"), (None, 1, a, "y")] + [(10, k, (u, a)[k % 2], f"t{k}") for k in range(300)] + [(11, 0, a, "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = p.format_pairs(p.pairs_from_conversations(p.conversations(df.withColumn("chosen", df.turn).withColumn("_apart", df.turn)))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found if r.conv_id is not None} == brute([r for r in rows if r[0] is not None])
    # Turns without a conversation are conversations of one turn.
    alone = sorted(tuple(r)[1:] for r in found if r.conv_id is None)
    assert alone == sorted(brute([r])[None] for r in rows if r[0] is None) and len(alone) == 2
    assert p.format_pairs(p.pairs_from_conversations(p.conversations(df.where("false")))).count() == 0


def test_prefix_of_different_lengths(spark):
    row = "struct<role:string,text:string>"
    df = spark.sql(f"select 1L conv_id, cast(array(('u','1'),('a','2'),('u','3')) as array<{row}>) chosen, cast(array(('u','1'),('a','2')) as array<{row}>) rejected")
    (r,) = p.format_pairs(df).collect()
    assert (r.status, r.prompt_turns, r.chosen_completion, r.rejected_completion, r.rejected_mask) == ("paired", 2, render([("u", "3")]), "", "")
