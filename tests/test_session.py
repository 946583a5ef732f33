"""Intermediate tables and their scopes."""

import threading

import pytest

from lodestore.session import materialize, scratch


def test_threads_keep_their_own_tables(spark):
    """A table that one thread writes stays readable when another leaves its scope."""
    opened, written = threading.Event(), threading.Event()
    found = []

    def other():
        opened.wait(60)
        with scratch():
            df = materialize(spark.range(7))
            written.set()
            done.wait(60)
            found.append(df.count())

    done = threading.Event()
    t = threading.Thread(target=other)
    t.start()
    with scratch():
        materialize(spark.range(3))
        opened.set()
        assert written.wait(60)
    done.set()
    t.join(60)
    assert found == [7]


def test_kept_tables_belong_to_the_scope_around(spark):
    with scratch():
        with scratch("kept"):
            kept, gone = materialize(spark.range(2), "kept"), materialize(spark.range(2), "gone")
        assert kept.count() == 2
        with pytest.raises(Exception, match="PATH|exist|File"):
            gone.count()
    with pytest.raises(Exception, match="PATH|exist|File"):
        spark.read.parquet(kept._lodestore_path).count()
