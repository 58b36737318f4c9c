"""Binary files by local path or by URI."""

from __future__ import annotations

from contextlib import contextmanager


@contextmanager
def opened(path: str):
    """A file for reading: a plain path, ``file://`` or the URI of any store that pyarrow reads, from the driver or a task."""
    if "://" not in path:
        with open(path, "rb") as f:
            yield f
        return
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    with system.open_input_file(where) as f:
        yield f


#: Bytes of a part that one task copies.
PIECE = 256 << 20
#: Bytes held at a time.
HELD = 8 << 20


def join_parts(spark, folder: str, path: str, head: bytes = b"") -> None:
    """The text parts of ``folder``, in the order of their names, as one new file at ``path`` with ``head`` before them.  No task and no
    driver sees it whole.

    The parts' lengths, one number each, give every part its place.  In a file system with places (a local or mounted one) the file is
    made at its length and tasks copy pieces into their places; a task that runs again writes the same bytes.  Elsewhere the store
    appends the parts itself (``concat``, as HDFS does); one that can't is an error that leaves the parts.  The file appears when it is whole.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path
    source, target = where(folder), where(path)
    system = target.getFileSystem(conf)
    parts = sorted((p.getPath().toString(), p.getLen()) for p in source.getFileSystem(conf).listStatus(source) if p.getPath().getName().startswith("part-") and p.getLen())
    target = system.makeQualified(target)
    if system.exists(target):
        raise FileExistsError(path)
    unfinished = where(target.getParent(), f"_{target.getName()}.unfinished")
    out = system.create(unfinished, True)
    out.write(bytearray(head))
    out.close()
    if target.toUri().getScheme() == "file":
        local, pieces, at = unfinished.toUri().getPath(), [], len(head)
        for name, n in parts:
            plain = name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name
            pieces += [(plain, i, at + i, min(PIECE, n - i)) for i in range(0, n, PIECE)]
            at += n
        with open(local, "r+b") as f:
            f.truncate(at)

        def copy(rows):
            for name, begin, to, n in rows:
                with opened(name) as src, open(local, "r+b") as dst:
                    src.seek(begin)
                    dst.seek(to)
                    while n:
                        got = src.read(min(n, HELD))
                        if not got:
                            raise EOFError(name)
                        dst.write(got)
                        n -= len(got)

        if pieces:
            frame = spark.createDataFrame(pieces, "name string, begin long, place long, n long")
            frame.repartitionByRange(min(len(pieces), 4 * spark.sparkContext.defaultParallelism), "place").foreachPartition(copy)
        # a checksum file of the empty file would no longer fit
        system.delete(where(unfinished.getParent(), f".{unfinished.getName()}.crc"), False)
    elif parts:
        array = spark.sparkContext._gateway.new_array(where, len(parts))
        for i, (name, _) in enumerate(parts):
            array[i] = where(name)
        system.concat(unfinished, array)
    system.rename(unfinished, target)
