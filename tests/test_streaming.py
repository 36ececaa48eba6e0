from loomgraph.streaming.reingest import watch


def test_files_come_once(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    seen = []

    def apply(docs, number):
        seen.append(sorted((r.source.rsplit("/", 1)[-1], r.text) for r in docs.collect()))

    (folder / "a.md").write_text("# A\nx")
    (folder / "b.txt").write_text("no")
    watch(spark, str(folder), str(tmp_path / "check"), apply).awaitTermination()
    (folder / "c.MD").write_text("y")
    watch(spark, str(folder), str(tmp_path / "check"), apply).awaitTermination()
    assert [batch for batch in seen if batch] == [[("a.md", "# A\nx")], [("c.MD", "y")]]
