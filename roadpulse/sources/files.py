"""Small marker files and folders, through the store that the cluster's paths name."""

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    store, place = _at(spark, path)
    return store.exists(place)


def delete_matching(spark: SparkSession, pattern: str) -> None:
    """Deletes the folders that match, with what is in them."""
    store, place = _at(spark, pattern)
    for found in store.globStatus(place) or []:
        store.delete(found.getPath(), True)


def _written(spark: SparkSession, path: str, text: str) -> None:
    """Under another name first, so that a broken write leaves no partial file."""
    store, place = _at(spark, path)
    _, partial = _at(spark, f"{path}.partial")
    out = store.create(partial, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(place, False)
    store.rename(partial, place)


def _read(spark: SparkSession, path: str) -> str:
    store, place = _at(spark, path)
    into = store.open(place)
    try:
        return bytes(into.readAllBytes()).decode()
    finally:
        into.close()


def keep_words(spark: SparkSession, path: str, words: list[str]) -> None:
    """A small file of a few words, written whole or not at all."""
    _written(spark, path, "\n".join(words))


def kept_words(spark: SparkSession, path: str) -> list[str]:
    """The words kept at ``path``, none if there is no such file."""
    return _read(spark, path).split() if path_exists(spark, path) else []


def kept_number(spark: SparkSession, path: str, make) -> int:
    """The number in the file at ``path``, which is made and written at the first call and never changes."""
    if not path_exists(spark, path):
        _written(spark, path, str(int(make())))
    return int(_read(spark, path))


def claimed_number(spark: SparkSession, folder: str) -> int:
    """One past the largest number claimed in a folder, which no one else gets: a file of that name is made only if there is none."""
    number = max(numbered_files(spark, folder), default=0) + 1
    while True:
        store, place = _at(spark, f"{folder}/{number}")
        store.mkdirs(place.getParent())
        if store.createNewFile(place):
            return number
        number += 1


def numbered_folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the folders named ``prefix`` and a number."""
    store, place = _at(spark, f"{path}/{prefix}*")
    return sorted(int(f.getPath().getName()[len(prefix) :]) for f in store.globStatus(place) or [])


def numbered_files(spark: SparkSession, path: str) -> list[int]:
    """The numbers that are names of files in a folder."""
    store, place = _at(spark, f"{path}/*")
    names = (f.getPath().getName() for f in store.globStatus(place) or [])
    return sorted(int(n) for n in names if n.isdigit())


def named_folders(spark: SparkSession, path: str, columns: list[str]) -> list[tuple[str, ...]]:
    """The values of all partition folders below ``path``."""
    store, place = _at(spark, "/".join([path, *(f"{c}=*" for c in columns)]))
    found = [f.getPath().toString().split("/")[-len(columns) :] for f in store.globStatus(place) or []]
    return sorted(tuple(name.split("=", 1)[1] for name in names) for names in found)


def replace_folder(spark: SparkSession, source: str, target: str) -> None:
    store, place = _at(spark, target)
    store.delete(place, True)
    store.mkdirs(place.getParent())
    store.rename(_at(spark, source)[1], place)


def tier_start(n: int, fan_in: int) -> int | None:
    """Where the folders begin that are merged once ``n`` are done, in tiers of ``fan_in`` times the size, if any are.

    Like the digits of a number: of n folders as many are left as its digits in base ``fan_in`` add up to.
    """
    if n <= 0 or n % fan_in:
        return None
    width = fan_in
    while n % (width * fan_in) == 0:
        width *= fan_in
    return n - width
