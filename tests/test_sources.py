from tessella.cli import main
from tessella.sources import generators, readers, sinks


def test_keyed_rows(spark, tmp_path):
    (tmp_path / "R.dat").write_text("k\nk\t\n\nk\tv\tw\t\t\nk\t\tv\n\tv\n7\ta\r\n")
    got = [tuple(r) for r in readers.read_keyed(spark, str(tmp_path / "R.dat")).collect()]
    assert got == [("k", "v\tw"), ("k", "\tv"), ("", "v"), ("7", "a")]


def test_relations_ignore_other_files(spark, tmp_path):
    for name, text in (("R.dat", "1\tr\n"), ("S.dat", "1\ts\n"), ("x.txt", "1\tx\n")):
        (tmp_path / name).write_text(text)
    r, s = readers.read_relations(spark, str(tmp_path))
    assert [tuple(x) for x in r.collect()] == [("1", "r")] and [tuple(x) for x in s.collect()] == [("1", "s")]


def test_edges_and_adjacency(spark, tmp_path):
    (tmp_path / "e").write_text("a\tb\nb\tc\textra\nbad\n")
    (tmp_path / "adj").write_text("a:b,c\nd:\nnothing\n")
    assert sorted(map(tuple, readers.read_edges(spark, str(tmp_path / "e")).collect())) == [("a", "b"), ("b", "c")]
    assert sorted(map(tuple, readers.read_adjacency(spark, str(tmp_path / "adj")).collect())) == [("a", "b"), ("a", "c")]


def test_sink_overwrites(spark, tmp_path):
    for rows in ([("a", 1)], [("b", None)]):
        sinks.write_keyed(spark.createDataFrame(rows, "k string, v int"), str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["b\t"]


def test_generators(spark):
    a, b = (generators.relation(spark, "age", "R", 500, seed=3).repartition(n).orderBy("payload").collect() for n in (1, 7))
    assert a == b and len(a) == 500 and all(0 <= int(r["key"]) < 100 for r in a)
    marks, names = generators.students(spark, 50)
    assert names.count() == 50 and all(2.0 <= r["gpa"] <= 4.9 for r in marks.collect())


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "R.dat").write_text("1\tr1\n2\tr2\n")
    (tmp_path / "in" / "S.dat").write_text("1\ts1\n1\ts2\n")
    read = lambda o: sorted(r.value for r in spark.read.text(str(tmp_path / o)).collect())
    assert main(["join", str(tmp_path / "in"), str(tmp_path / "j"), "--strategy", "semi_reduced"]) == 0
    assert read("j") == ["1\tr1\ts1", "1\tr1\ts2"]
    main(["theta", str(tmp_path / "in"), str(tmp_path / "t")])
    assert read("t") == ["2\tr2\t1\ts1", "2\tr2\t1\ts2"]
    main(["wordcount", str(tmp_path / "in"), str(tmp_path / "w")])
    assert "1\t3" in read("w")
    main(["invindex", str(tmp_path / "in"), str(tmp_path / "i")])
    assert "1\tR.dat:1,S.dat:2" in read("i")
    main(["pagerank", str(tmp_path / "in" / "R.dat"), str(tmp_path / "p")])
    assert len(read("p")) == 4
    assert "iteration 1: distance" in capsys.readouterr().err
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    main(["--reducers", "3", "--print", "join", str(tmp_path / "in"), str(tmp_path / "r"), "--strategy", "merge"])
    assert sorted(capsys.readouterr().out.split()) == sorted("1 r1 s1 1 r1 s2".split()) and read("r") == read("j")
    main(["--print", "invindex", str(tmp_path / "in"), str(tmp_path / "i")])
    assert "1\tR.dat:1,S.dat:2\n" in capsys.readouterr().out
    for k, v in before.items():
        spark.conf.set(k, v)


def test_relations_in_folders_of_parts(spark, tmp_path):
    for name, text in (("xR.dat", "1\tr"), ("yS.dat", "1\ts"), ("z", "1\tz")):
        spark.createDataFrame([(text,)], "value string").write.text(str(tmp_path / "both" / name))
    r, s = readers.read_relations(spark, str(tmp_path / "both"))
    assert [tuple(x) for x in r.collect()] == [("1", "r")] and [tuple(x) for x in s.collect()] == [("1", "s")]
