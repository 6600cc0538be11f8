import pytest

from typeloom import session


class Conf(dict):
    """Only what the folder rules read of a session."""

    def get(self, key, default=None):
        return super().get(key, default)


class Stub:
    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"stub-{master}"})()


def test_the_cluster_names_the_folder():
    stub = Stub("yarn", **{"spark.checkpoint.dir": "/shared/work/"})
    assert session.shared_folder(stub) == "/shared/work"
    first, second = session.fresh_path(stub, "x"), session.fresh_path(stub, "x")
    assert first != second and first.startswith("/shared/work/x-")


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Stub("yarn"))
    assert session.shared_folder(Stub("local[2]")) == session.shared_folder(Stub("local[2]"))


def test_checkpoint_keeps_rows(spark):
    assert session.checkpointed(spark.range(5)).count() == 5


def test_workers_import_the_package(spark):
    def loaded(batches):
        import typeloom.functions.lexical as lexical

        for batch in batches:
            assert lexical.BLANKS
            yield batch

    assert spark.range(3).mapInArrow(loaded, "id bigint").count() == 3
