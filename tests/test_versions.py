"""Tables of versions: no reader misses them, and no writer's rows get lost."""

import threading

import pytest

from clausegrain.sources import versions


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v string")


def table(spark, path, version=None):
    return sorted(map(tuple, versions.read(spark, path, version).collect()))


def test_versions_follow_one_another(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    assert versions.current(spark, path) == 0
    assert versions.write(rows(spark, [(1, "a"), (2, "b")]), path) == 1
    old = versions.read(spark, path)
    assert versions.write(versions.read(spark, path).where("k = 1"), path) == 2
    assert table(spark, path) == [(1, "a")] and table(spark, path, 1) == [(1, "a"), (2, "b")] and old.count() == 2
    assert versions.upsert(rows(spark, [(1, "c"), (3, "d")]), path, "k") == 3
    assert versions.upsert(rows(spark, [(3, "e")]), path, "k", keep=("v",)) == 4
    assert table(spark, path) == [(1, "c"), (3, "d")]
    assert versions.shrink(rows(spark, [(1, "x"), (None, "y")]), path, "k") == 5
    assert table(spark, path) == [(3, "d")]
    versions.vacuum(spark, path)
    assert versions.versions(spark, path) == [4, 5] and len(list((tmp_path / "t" / "data").iterdir())) == 2 and table(spark, path) == [(3, "d")]


def test_of_two_writers_from_one_version_one_loses(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    versions.write(rows(spark, [(1, "a")]), path)
    assert versions.write(rows(spark, [(2, "b")]), path, expected=1) == 2
    with pytest.raises(versions.Conflict):
        versions.write(rows(spark, [(3, "c")]), path, expected=1)
    assert table(spark, path) == [(2, "b")] and len(list((tmp_path / "t" / "data").iterdir())) == 2  # the loser leaves nothing


def test_writers_at_once_and_readers_between(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    versions.write(rows(spark, [(0, "start")]), path)
    failed, sizes, done = [], [], threading.Event()

    def reader():
        while not done.is_set():
            try:
                sizes.append(versions.read(spark, path).count())
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    def writer(k):
        try:
            for i in range(3):
                versions.upsert(rows(spark, [(10 * k + i + 1, f"w{k}")]), path, "k")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    watch = threading.Thread(target=reader)
    watch.start()
    writers = [threading.Thread(target=writer, args=(k,)) for k in (1, 2)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    done.set()
    watch.join()
    assert not failed and versions.current(spark, path) == 7
    assert [k for k, _ in table(spark, path)] == [0, 11, 12, 13, 21, 22, 23]
    assert sizes and set(sizes) <= set(range(1, 8)) and sizes == sorted(sizes)
