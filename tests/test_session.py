"""Where lineage is cut to."""

import pytest

from taleloom.session import _folder_for, checkpoint_folder


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]", "local-cluster[3,2,1024]", "yarn", "spark://host:7077"])
def test_checkpoint_folder(master):
    assert _folder_for(master, "s3://shared/cp", "/warehouse") == "s3://shared/cp"
    if master.startswith("local") and "cluster" not in master:
        assert _folder_for(master, None, "/warehouse/") == "/warehouse/_checkpoints"
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            _folder_for(master, None, "/warehouse")


def test_session_uses_the_named_folder(spark):
    assert checkpoint_folder(spark).startswith(("file:", "/")) and spark.conf.get("spark.checkpoint.dir") in checkpoint_folder(spark)


def test_shuffle_files_go_with_their_query(spark):
    """Intermediate tables leave no shuffle files behind, and later queries run as before."""
    import time

    from taleloom.session import _CLEANUP, cut_lineage, stored

    before = spark.conf.get(_CLEANUP, None)
    files = lambda: {f for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    held = files()
    x = spark.range(1000).repartition(5, "id")
    a, b = stored(x), cut_lineage(x)
    for _ in range(50):
        if left := files() - held:
            time.sleep(0.2)
    assert not left
    assert a.count() == b.count() == x.count() == 1000 and spark.conf.get(_CLEANUP, None) == before
