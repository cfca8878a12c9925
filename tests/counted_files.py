"""A file system for tests: the local one, which notes each range that is read in a file beside it."""

import os

import pyarrow as pa
from pyarrow import fs as pafs


class _File:
    closed = False

    def __init__(self, path):
        self.path, self.f = path, open(path, "rb")

    def read(self, n=-1):
        with open(self.path + ".log", "a") as log:
            log.write(f"{self.f.tell()} {n}\n")
        return self.f.read(n)

    def seek(self, *a):
        return self.f.seek(*a)

    def tell(self):
        return self.f.tell()

    def readable(self):
        return True

    def seekable(self):
        return True

    def writable(self):
        return False

    def close(self):
        self.f.close()

    def size(self):
        return os.path.getsize(self.path)


class _Handler(pafs.FileSystemHandler):
    def get_type_name(self):
        return "counted"

    def get_file_info(self, paths):
        return pafs.LocalFileSystem().get_file_info(paths)

    def open_input_file(self, path):
        return pa.PythonFile(_File(path), mode="r")

    open_input_stream = open_input_file

    def normalize_path(self, path):
        return path

    def _none(self, *a):
        raise NotImplementedError

    get_file_info_selector = create_dir = delete_dir = delete_dir_contents = delete_root_dir_contents = delete_file = move = copy_file = open_output_stream = open_append_stream = _none


def counted(uri):
    return pafs.PyFileSystem(_Handler()), uri.removeprefix("counted://")
