"""Small tables with what real ones hold: nulls, empty and long texts, repeated rows, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, ids string, score string, bucket int, n_hit string, a string"

WORDS = "the quick brown fox jumps over the lazy dog and then some more words follow until the line is long enough to matter".split()


def odd_rows():
    base = " ".join(WORDS * 3)
    rows = [
        (10, base),
        (11, base),
        (12, base.replace("lazy", "idle", 1)),
        (13, None),
        (14, ""),
        (15, " \n\t "),
        (16, "Re."),
        (17, " ".join(f"w{k}" for k in range(20_000))),
        (18, "x" * 5000),
        (19, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. É ñ 漢字 🙂\x00 end"),
        (20, "one two three"),
        (20, "one two three"),
        (None, base),
        (-5, "… !? 123 --"),
    ]
    return [(k, t, "en" if k != 11 else None, "s", len(t) if t else None, "x", "y", "z", 7, "h", "a") for k, t in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], r[1]) for r in odd_rows()]


def components(nodes, linked):
    """Smallest reachable node of each, by brute force."""
    out = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(out[a], out[b])
            if out[a] != low or out[b] != low:
                out[a] = out[b] = low
                changed = True
    return out
