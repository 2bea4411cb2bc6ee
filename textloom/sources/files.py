"""Files in the folder that driver and executors share, wherever it is: a path, file:, hdfs: or an object store's URI."""

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType, LocalFileSystem


def located(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri) if ":/" in uri else (LocalFileSystem(), uri)


def opened(uri: str) -> pa.NativeFile:
    files, path = located(uri)
    return files.open_input_file(path)


def exists(files: FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != FileType.NotFound
