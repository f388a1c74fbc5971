import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import lines


def files(spark, *rows):
    return spark.createDataFrame([(i, s, m) for i, (s, m) in enumerate(rows)], "file_id long, source string, sloc_mode string")


@pytest.mark.parametrize(
    "source, mode, expected",
    [
        ("a\n/* tools:off */\nb\nc\n/* tools:on */\nd\n", "Default", [(2, 36, 2, 5, None)]),
        ("// tools:off gauge\n", "Default", [(0, 19, 1, 1, ["gauge"])]),
        ("// tools:off scans, sec,\nx", "Default", [(0, 26, 1, 2, ["scans", "sec"])]),
        ("x\n# tools:off\ny\n# tools:on\n", "Python", [(2, 26, 2, 4, None)]),
        ("-- tools:off\n-- tools:on\n", "Ada", [(0, 24, 1, 2, None)]),
        ("! tools:off\n", "Fortran", [(0, 12, 1, 1, None)]),
        ("// tools:off\n// tools:off a\n// z\ny\n// tools:on\n", "Default", [(0, 46, 1, 5, None)]),
        ("// tools:offline\n// tools:off ,\n// tools:on\n// tools:off\tx\n// tools:on x\n", "Default", []),
        ("", "Default", []),
        ("--[[ tools:off ]]\n", "Lua", []),
        ("/* tools:off */ /* x */\n", "Default", [(0, 24, 1, 1, ["*/ /* x"])]),
        ("\u00a0// tools:off\u2003\né\n// tools:on", "Default", [(0, 32, 1, 3, None)]),
    ],
)
def test_regions(spark, source, mode, expected):
    got = lines.ignored_regions(files(spark, (source, mode))).orderBy("line_start").collect()
    assert [tuple(r)[1:] for r in got] == expected


def test_regions_against_a_state_machine(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["// tools:off", "// tools:on", "x", "// tools:off a"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    got = {}
    for r in lines.ignored_regions(files(spark, *[(t, "Default") for t in texts])).collect():
        got.setdefault(r["file_id"], []).append((r["line_start"], r["line_end"]))
    for i, t in enumerate(texts):
        want, open_ = [], None
        rows = t.split("\n")
        for k, line in enumerate(rows, 1):
            if line.startswith("// tools:off") and open_ is None:
                open_ = k
            elif line == "// tools:on" and open_ is not None:
                want.append((open_, k))
                open_ = None
        if open_ is not None:
            want.append((open_, len(rows)))
        assert sorted(got.get(i, [])) == want


def test_applies_to(spark):
    df = spark.createDataFrame([(["Scans"],), (None,)], "tools array<string>")
    assert [r[0] for r in df.select(lines.region_applies_to(F.col("tools"), "sCANS")).collect()] == [True, True]
    assert [r[0] for r in df.select(lines.region_applies_to(F.col("tools"), "sec")).collect()] == [False, True]


@pytest.mark.parametrize(
    "source, mode, expected",
    [
        ('// tools:suppress sec:R1 HASH:ab JUSTIFICATION:"one, two"\nx();\n', "Default", [(1, 2, "sec", "R1", "ab", "one, two")]),
        ("// tools:suppress a:b:c\n\n\nx\n", "Default", [(1, 4, "a", "b:c", None, None)]),
        ("x\n# tools:suppress a:b", "Python", [(2, None, "a", "b", None, None)]),
        ("// tools:suppress sec\ny\n// tools:suppress :r\n// tools:suppress t:\n// ok\n", "Default", []),
        ("// tools:suppress a:b HASH:1 HASH:2 other\r\ny\r\n", "Default", [(1, 2, "a", "b", "2", None)]),
    ],
)
def test_suppressions(spark, source, mode, expected):
    got = lines.suppressions(files(spark, (source, mode))).orderBy("comment_line").collect()
    assert [tuple(r)[1:] for r in got] == expected


def test_single_file_forms_agree(spark):
    from codeloom.functions import markers, sqlfuncs

    rng = random.Random(9)
    bits = ["// tools:off", "// tools:on", "/* tools:off a, b */", "/* tools:off */ /* x */", "x", "", " \u00a0", '// tools:suppress a:b JUSTIFICATION:"q r" HASH:1', "// tools:suppress a", "é\r", "# tools:off", "-- tools:off", "--[[ tools:on ]]"]
    rows = [("\n".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) + rng.choice(["", "\n"]), rng.choice(["Default", "Python", "Lua", "Ada"])) for _ in range(80)]
    f = files(spark, *rows)
    for table, one in ((lines.ignored_regions(f), markers.regions), (lines.suppressions(f), markers.suppressions)):
        got = {}
        for r in table.collect():
            got.setdefault(r["file_id"], []).append(tuple(r)[1:])
        for i, (source, mode) in enumerate(rows):
            assert sorted(got.get(i, []), key=str) == sorted(one(source, mode), key=str), (source, mode)
    sqlfuncs.register(spark)
    assert spark.sql("SELECT line_end FROM ignored_regions('c', '// tools:off')").first()[0] == 1
    assert spark.sql("SELECT rule FROM suppressions('python', '# tools:suppress a:b')").first()[0] == "b"
    assert spark.sql("SELECT count(*) FROM languages()").first()[0] == 16
    with pytest.raises(Exception, match="unknown language key"):
        spark.sql("SELECT * FROM suppressions('tsx', '')").collect()
