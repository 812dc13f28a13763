import json
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pipeweave.lang.diagnostics import ProgramError
from pipeweave.session import Engine
from pipeweave.sources.writers import to_bytes


@pytest.fixture
def files(tmp_path):
    (tmp_path / "visits.csv").write_text("city,day,n\nRome,2,5\nOslo,1,\nRome,1,7.5\nOslo,2,1\n,1,3\n")
    (tmp_path / "cities.csv").write_text("city,land\nRome,IT\nParis,FR\n")
    (tmp_path / "odd.csv").write_text('k,v,t\na,1,2024-03-07\nb,true,2024-03-07T23:30:00-05:00\nc," x, ""y""",2024-12-30T01:02:03.5Z\nd,,nonsense\n')
    return tmp_path


def text(spark, files, program, **options):
    r = Engine(spark, program, folder=str(files), **options).run()
    return to_bytes(r.table, "csv").decode()


@pytest.mark.parametrize("parts", ["1", "4", "17"])
def test_order_and_groups(spark, files, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert text(spark, files, 'load "visits.csv" | sort n desc') == "city,day,n\nRome,1,7.5\nRome,2,5\n,1,3\nOslo,2,1\nOslo,1,\n"
    assert text(spark, files, 'load "visits.csv" | sort n desc nulls_last | limit 2') == "city,day,n\nOslo,1,\nRome,1,7.5\n"
    assert text(spark, files, 'load "visits.csv" | group_by city | agg s = sum(n), c = count(n), m = mean(n)') == "city,s,c,m\nOslo,1,1,1\nRome,12.5,2,6.25\n,3,1,3\n"
    assert text(spark, files, 'load "visits.csv" | distinct city') == "city,day,n\nRome,2,5\nOslo,1,\n,1,3\n"
    assert text(spark, files, 'load "visits.csv" | filter city != null | complete city, day fill n = 0') == "city,day,n\nRome,2,5\nRome,1,7.5\nOslo,2,1\nOslo,1,\n"
    assert text(spark, files, 'load "visits.csv" | filter n > 100 | agg c = count(), s = sum(n)') == "c,s\n0,\n"
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_joins(spark, files):
    run = lambda kind: text(spark, files, f'let c = load "cities.csv" load "visits.csv" | join c on city kind {kind} | select city, day')
    assert run("left") == "city,day\nRome,2\nOslo,1\nRome,1\nOslo,2\n,1\n"
    assert run("inner") == run("semi") == "city,day\nRome,2\nRome,1\n"
    assert run("anti") == "city,day\nOslo,1\nOslo,2\n,1\n"
    assert run("right") == "city,day\nRome,2\nRome,1\nParis,\n"
    assert run("full") == "city,day\nRome,2\nOslo,1\nRome,1\nOslo,2\n,1\nParis,\n"


def test_mixed_cells_and_text(spark, files):
    assert text(spark, files, 'load "odd.csv" | select k, v') == 'k,v\na,1\nb,true\nc," x, ""y"""\nd,\n'
    assert text(spark, files, 'load "odd.csv" | mutate n = to_number(v), s = concat(k, v), e = v == 1 | select n, s, e') == (
        'n,s,e\n1,a1,true\n,btrue,false\n,"c x, ""y""",\n,d,\n'
    )


def test_temporal(spark, files):
    got = text(spark, files, 'load "odd.csv" | mutate d = date(t), x = datetime(t), w = date_floor(t, "week"), f = date_format(t, "%G-W%V %H%z") | select d, x, w, f')
    assert got.splitlines()[1:] == [
        "2024-03-07,,2024-03-04,", "2024-03-07,2024-03-07T23:30:00-05:00,2024-03-04T00:00:00-05:00,2024-W10 23-0500",
        "2024-12-30,2024-12-30T01:02:03Z,2024-12-30T00:00:00Z,2025-W01 01+0000", ",,,",
    ]


def test_numbers(spark, files):
    got = text(spark, files, 'load "cities.csv" | limit 1 | mutate a = 10000000000, b = 12345678.5, c = 0.00001234, d = 1 / 0, e = -1 / 0, f = 0 / 0, g = 5 % 0, h = round(2.5), i = round(-2.5), j = round(1.005, 2), k = 1e30 | drop city, land')
    assert got.splitlines()[1] == "10000000000,12345678.5,0.00001234,inf,-inf,NaN,NaN,3,-3,1,1000000000000000000000000000000"


def test_windows(spark, files):
    got = text(spark, files, 'load "visits.csv" | filter city != null | mutate r = sum(n) over (partition_by city order_by day frame running), l = lag(n, day, -1) over (partition_by city order_by day), k = rank() over (order_by n desc) | select city, day, r, l, k')
    assert got == "city,day,r,l,k\nRome,2,12.5,-1,2\nOslo,1,,-1,4\nRome,1,7.5,-1,1\nOslo,2,1,-1,3\n"


def test_row_dependent_offsets(spark, files):
    program = 'load "visits.csv" | filter n != null | mutate a = lag(n, day - 1, -1) over (partition_by city order_by day), b = lead(n, 2 - day, 0) over (order_by n) | select city, a, b'
    assert text(spark, files, program) == "city,a,b\nRome,7.5,5\nRome,7.5,0\nOslo,-1,1\n,3,5\n"
    assert "collect_list" not in Engine(spark, program, folder=str(files)).run().table.df._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="E1206"):
        text(spark, files, 'load "visits.csv" | mutate a = lag(n, 0 - day) over (partition_by city order_by day)')


def test_union_and_pivot(spark, files):
    assert text(spark, files, 'let c = load "cities.csv" load "visits.csv" | limit 1 | union c by_name true') == "city,day,n,land\nRome,2,5,\nRome,,,IT\nParis,,,FR\n"
    assert text(spark, files, 'load "visits.csv" | limit 1 | pivot_longer day, n names_to k values_to v') == "city,k,v\nRome,day,2\nRome,n,5\n"
    with pytest.raises(ProgramError) as e:
        text(spark, files, 'let c = load "cities.csv" | select land load "visits.csv" | select n | union c')
    assert e.value.code == "E1209"


def test_contexts_outputs_controls(spark, files):
    program = 'param city = input_select(label: "C", choicesFrom: all.city, default: "Rome") state least = 2 let all = load "visits.csv" output a = all | filter city == $city and n > @least output b = all | agg n = count()'
    e = Engine(spark, program, folder=str(files), context={"least": 6})
    r = e.run()
    assert to_bytes(r.outputs["a"], "csv").decode() == "city,day,n\nRome,1,7.5\n" and list(r.outputs) == ["a", "b"]
    assert e.controls()[0]["choices"] == ["Rome", "Oslo"]
    for given, code in (({"least": "x"}, "E2005"), ({"nope": 1}, "E2002")):
        with pytest.raises(ProgramError) as x:
            Engine(spark, program, context=given)
        assert x.value.code == code


@pytest.mark.parametrize("code,program", [
    ("E1005", 'load "visits.csv" | select nope'), ("E1207", 'load "visits.csv" | select city, city = day'), ("E1302", 'load "visits.csv" | mutate x = city + 1'),
    ("E1401", 'load "visits.csv" | mutate x = nope(city)'), ("E1402", 'load "visits.csv" | mutate x = lower(city, day)'), ("E1208", 'let c = load "cities.csv" load "visits.csv" | join c on (day, city)'),
    ("E1226", 'load "visits.csv" | filter row_number() over (order_by n) == 1'), ("E1203", 'load "visits.csv" | mutate x = rank() over (partition_by city)'), ("E1406", 'load "visits.csv" | mutate x = date_floor(city, "hour")'),
    ("E1501", 'let a = b | limit 1 let b = a | limit 1 a | limit 1'), ("E1801", 'load "missing.csv" | limit 1'),
])
def test_codes(spark, files, code, program):
    with pytest.raises(ProgramError) as e:
        Engine(spark, program, folder=str(files)).run()
    assert e.value.code == code


@pytest.mark.parametrize("kind", ["csv", "jsonl", "parquet", "arrow-file", "arrow-stream"])
def test_formats_round_trip(spark, files, kind):
    table = Engine(spark, 'load "visits.csv"', folder=str(files)).run().table
    data = to_bytes(table, kind)
    (files / "again").write_bytes(data)
    want = to_bytes(table, "csv")
    assert to_bytes(Engine(spark, f'load "again" format {kind}', folder=str(files)).run().table, "csv") == want
    assert to_bytes(Engine(spark, "load stdin", stdin=data).run().table, "csv") == want


def test_jsonl_classes(spark, files):
    (files / "x.jsonl").write_text('{"b":1,"a":"s"}\n\n{"a":true,"c":{"z":[1,"q"]}}\n{"b":2.5,"a":3}\n')
    assert text(spark, files, 'load "x.jsonl"') == 'b,a,c\n1,s,\n,true,"{""z"":[1,""q""]}"\n2.5,3,\n'


def test_saves(spark, files, monkeypatch):
    monkeypatch.chdir(files)
    r = Engine(spark, 'load "visits.csv" | save "a.csv" | agg n = count() | save stdout format jsonl', folder=str(files)).run()
    assert (files / "a.csv").read_text() == (files / "visits.csv").read_text() and r.stdout == b'{"n":5}\n'


def test_spatial(spark, files):
    (files / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"city": "Rome", "n": "7"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"city": "Oslo"}, "geometry": None},
    ]}))
    r = Engine(spark, 'let c = load "cities.csv" load "g.geojson" | join c on city kind left', folder=str(files)).run().table
    got = json.loads(to_bytes(r, "geojson"))
    assert [f["properties"] for f in got["features"]] == [{"city": "Rome", "n": 7, "land": "IT"}, {"city": "Oslo", "n": None, "land": None}]
    for program, code in (('load "g.geojson" | save "x.csv"', "E1711"), ('load "cities.csv" | save "x.geojson"', "E1712"), ('load "g.geojson" | sort geom', "E1234"), ('let g = load "g.geojson" load "g.geojson" | join g on geom', "E1233")):
        with pytest.raises(ProgramError) as e:
            Engine(spark, program, folder=str(files)).run()
        assert e.value.code == code
    topo = {"type": "Topology", "transform": {"scale": [1, 1], "translate": [10, 0]}, "arcs": [[[0, 0], [1, 0], [0, 1]], [[1, 1], [-1, 0], [0, -1]]], "objects": {"o": {"type": "Polygon", "arcs": [[0, 1]], "properties": {"a": 1}}}}
    (files / "t.topojson").write_text(json.dumps(topo))
    t = json.loads(to_bytes(Engine(spark, 'load "t.topojson"', folder=str(files)).run().table, "geojson"))
    assert t["features"][0]["geometry"]["coordinates"] == [[[10, 0], [11, 0], [11, 1], [10, 1], [10, 0]]]
    body = struct.pack("<i2d", 1, 3.0, 4.0)
    (files / "s.shp").write_bytes(struct.pack(">i", 9994) + bytes(96) + struct.pack(">2i", 1, len(body) // 2) + body)
    (files / "s.dbf").write_bytes(struct.pack("<4sIHH20x", b"\x03", 1, 65, 4) + b"name".ljust(11, b"\0") + b"C" + bytes(4) + bytes([3]) + bytes(15) + b"\r" + b" abc")
    s = json.loads(to_bytes(Engine(spark, 'load "s.shp"', folder=str(files)).run().table, "geojson"))
    assert s["features"] == [{"type": "Feature", "properties": {"name": "abc"}, "geometry": {"type": "Point", "coordinates": [3, 4]}}]


def test_streaming_lift(spark, files):
    from pipeweave.streaming import lift

    pq.write_table(pa.table({"a": [1, 2, 3]}), files / "p.parquet")
    (files / "in").mkdir()
    pq.write_table(pa.table({"a": [1, 2, 3]}), files / "in" / "p.parquet")
    stream = spark.readStream.schema("a long").parquet(str(files / "in"))
    q = lift(stream, 'load stdin | filter a > 1 | mutate b = a * 2').writeStream.format("memory").queryName("lifted").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("lifted").collect())) == [(2, 4.0), (3, 6.0)]
    with pytest.raises(ProgramError):
        lift(stream, "load stdin | agg n = count()")


def test_pushdown(spark, files):
    pq.write_table(pa.table({"a": [1, 2, 3], "b": [1, 2, 3], "c": [1, 2, 3]}), files / "p.parquet")
    plan = Engine(spark, 'load "p.parquet" | filter a > 1 | select b', folder=str(files)).explain()["main"]["spark"]
    assert "ReadSchema: struct<a:bigint,b:bigint" in plan and "c:bigint" not in plan.split("ReadSchema")[-1] and "PushedFilters: [IsNotNull(a), GreaterThan(a,1)]" in plan


def test_quoted_line_ends_anywhere(spark, tmp_path):
    rows = "".join(f"{i},{'y' * 60}\n" for i in range(40_000))  # over two MB before the first quote
    (tmp_path / "late.csv").write_text("a,b\n" + rows + '7,"p\nq"\n8,z\n')
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "1.csv").write_text("a,b\n1,x\n")
    (tmp_path / "folder" / "2.csv").write_text('a,b\n2,"p\nq"\n3,"say ""hi"""\n')
    assert text(spark, tmp_path, 'load "late.csv" | filter a == 7 | filter b == null or starts_with(b, "p")') == 'a,b\n7,"p\nq"\n'
    assert text(spark, tmp_path, 'load "late.csv" | agg n = count()') == "n\n40002\n"
    assert text(spark, tmp_path, 'load "folder" format "csv" | sort a') == 'a,b\n1,x\n2,"p\nq"\n3,"say ""hi"""\n'


def test_last_of_equal_keys_holds(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1,"b":2,"a":3}\n{"b":4}\n')
    assert text(spark, tmp_path, 'load "x.jsonl"') == "a,b\n3,2\n,4\n"


def test_mixed_columns_sort_by_value(spark, tmp_path):
    (tmp_path / "m.csv").write_text("k,v\n1,10\n2,9\n3,zz\n4,true\n5,\n")
    assert text(spark, tmp_path, 'load "m.csv" | sort v | select v') == "v\n9\n10\ntrue\nzz\n\"\"\n"
    assert text(spark, tmp_path, 'load "m.csv" | agg lo = min(v), hi = max(v)') == "lo,hi\n9,zz\n"
    assert text(spark, tmp_path, 'load "m.csv" | sort v desc nulls_first | complete k | select k') == "k\n3\n4\n1\n2\n5\n"


def test_decimals_order_complete_and_huge_numbers_compare(spark, tmp_path):
    import decimal

    pq.write_table(pa.table({"k": [1, 2, 3], "x": pa.array([decimal.Decimal(v) for v in ("9.50", "10.25", "-3.00")])}), tmp_path / "d.parquet")
    assert text(spark, tmp_path, 'load "d.parquet" | sort x desc | complete k | select x') == "x\n10.25\n9.5\n-3\n"
    assert text(spark, tmp_path, 'load "d.parquet" | filter k < 1e400 | agg n = count()') == "n\n3\n"


def test_dates_reach_the_scan(spark, tmp_path):
    import datetime

    at = [datetime.datetime(1995, 1, 1), datetime.datetime(1995, 1, 1, 12, 0, 0, 500_000), datetime.datetime(1995, 1, 2), None]
    pq.write_table(pa.table({"k": [1, 2, 3, 4], "t": pa.array(at, pa.timestamp("us")), "d": pa.array([a and a.date() for a in at])}), tmp_path / "t.parquet")
    engine = Engine(spark, 'load "t.parquet" | filter t >= "1995-01-02"', folder=str(tmp_path)).run()
    assert "GreaterThanOrEqual" in engine.table.frame()._jdf.queryExecution().toString().split("PushedFilters")[1]
    # What the text of a time gives, whatever way it is compared.
    for column in ("t", "d"):
        for value in ("1995-01-01", "1995-01-02", "1995-01-01T00:00:00Z", "1995-01-01T12:00:00Z", "1995-01-01T12:00:01Z", "1995-02-30", "1995"):
            for op in ("<", "<=", ">", ">=", "==", "!="):
                program = 'load "t.parquet" | filter {} %s "%s" | sort k | select k' % (op, value)
                assert text(spark, tmp_path, program.format(column)) == text(spark, tmp_path, program.format(f"to_string({column})")), (column, op, value)
    parts = "y = year({0}), m = month({0}), q = day({0}), e = date({0}), f = datetime({0}), g = date_floor({0}, \"week\"), h = date_format({0}, \"%Y/%j %H:%M:%S %z\")"
    for column in ("t", "d"):
        program = 'load "t.parquet" | mutate %s | select k, y, m, q, e, f, g, h'
        assert text(spark, tmp_path, program % parts.format(column)) == text(spark, tmp_path, program % parts.format(f"to_string({column})"))


def test_save_in_mid_pipeline(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n2,x\n1,y\n")
    for kind, ending in (("parquet", "parquet"), ("arrow-file", "arrow"), ("csv", "csv")):
        out = tmp_path / f"out.{ending}"
        assert text(spark, tmp_path, f'load "a.csv" | sort k | save "{out}" | agg n = count()') == "n\n2\n"
        assert text(spark, tmp_path, f'load "{out}"') == "k,v\n1,y\n2,x\n"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.csv", "out.arrow", "out.csv", "out.parquet"]
