from strandloom.streaming.sequences import filtered_stream, write_stream


def test_fasta_stream_keeps_good_records_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: write_stream(filtered_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "a.fa").write_text(">one\nACGT\n>two\nNNNN\n")
    run()
    (tmp_path / "in" / "b.fa").write_text(">three\nACGTACGTN\n")
    run()
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "three"]
