"""CSV reading: paths with spaces, mixed encodings, quoted line ends, typing of wide tables."""

import os

from tallyscope.sources.csv import column_types, file_encodings, read_csv


def _write(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)


def test_folders_and_files_with_spaces_and_signs(spark, tmpdir_spark):
    folder = os.path.join(tmpdir_spark, "in put %41 +ü")
    _write(folder, "a file #1.csv", b"k,t\n1,caf\xe9\n")
    _write(folder, "b,2.csv", "k,t\n2,é€\n".encode())
    df = read_csv(spark, folder)
    assert sorted(map(tuple, df.collect())) == [(1, "café"), (2, "é€")]
    assert sorted(file_encodings(spark, folder).values()) == ["ISO-8859-1", "UTF-8"]
    one = read_csv(spark, [os.path.join(folder, "a file #1.csv")])
    assert [tuple(r) for r in one.collect()] == [(1, "café")]


def test_quoted_line_ends_are_found(spark, tmpdir_spark):
    _write(tmpdir_spark, "a.csv", b'k,t\n1,"two\nlines, ""quoted"""\n2,plain\n')
    assert sorted(map(tuple, read_csv(spark, tmpdir_spark).collect())) == [(1, 'two\nlines, "quoted"'), (2, "plain")]


def test_plain_files_are_split(spark, tmpdir_spark):
    _write(tmpdir_spark, "a.csv", b"k,t\n" + b"".join(b"%d,x%d\n" % (i, i) for i in range(40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = read_csv(spark, tmpdir_spark)
        assert df.rdd.getNumPartitions() > 2 and df.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_types_of_many_columns_come_from_one_scan(spark):
    rows = [tuple([str(i), "1.5" if i else "2", "True" if i else "false", "x" if i else "3", None, "9" * 25, "True" if i else "1"] * 30) for i in range(4)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(210)))
    kinds = list(column_types(df).values())
    assert kinds == ["bigint", "double", "boolean", "string", "double", "double", "string"] * 30
    assert column_types(df.limit(0)) == {c: "double" for c in df.columns}
