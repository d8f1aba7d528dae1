"""Prefixed pairs against a fold over lines; the log is read once whatever the names."""

import re

from fleetgauge.functions import text as tx

BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def folded(log, prefix, names):
    """The last text of every name, by lines."""
    out = dict.fromkeys(names)
    for line in re.split(BREAKS, log):
        if line.startswith(prefix) and "=" in line:
            name = line[len(prefix):].split("=", 1)[0]
            if name in out:
                out[name] = line.split("=", 1)[1]
    return out


def number(text):
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


def test_prefixed_pairs_equal_a_fold_over_lines(spark):
    logs = ["", "p.A=1", "p.A=1\np.A=2", " p.A=1", "xp.A=1\r\np.A=3\r\np.B=4", "p.A=1\x85p.B=2\u2028p.A=x\u2029", "p.A=1\x0bp.B", "p.AB=1\np.A=1=2\np.B=",
            "p.p.A=1\n\np.B=7\x1cpp.B=9\x1dp.=1\x1e", "pXA=1\np.A", "p.A=5\rp.A=é \x0cp.B=-2.5e1", "p.A=p.B=1", "text p.A=1 p.B=2\n" * 50 + "p.B=3\n"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*logs, None])], "i int, _lines string")
    for prefix, names in (("p.", ["B", "A"]), ("", ["p.A", "p.B"]), ("p.A=", ["1", "2"])):
        out = tx.parse_prefixed_pairs(df, "_lines", prefix, names)
        assert out.columns == ["i", "_lines", *names, "errors"]
        for row in out.orderBy("i").collect():
            want = folded(row["_lines"], prefix, names) if row["_lines"] is not None else dict.fromkeys(names)
            assert [row[n] for n in names] == [number(want[n]) for n in names], (prefix, row)
            missing = ", ".join(n for n in sorted(names) if want[n] is None)
            wrong = any(want[n] is not None and number(want[n]) is None for n in names)
            assert row["errors"] == ["invalid value"] * wrong + [f"missing fields: {missing}"] * (missing != ""), (prefix, row)


def test_the_log_is_read_once(spark, capsys):
    df = spark.createDataFrame([(1, "p.A=1")], "i int, log string")
    tx.parse_prefixed_pairs(df, "log", "p.", ["A", "B", "C"]).explain("extended")
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert plan.count("split(") + plan.count("regexp_extract_all(") == 1
