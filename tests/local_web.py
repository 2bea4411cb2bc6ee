"""An opener of pages for tests: files of a folder named by $TEXTLOOM_TEST_WEB, one for each URL; requests are noted beside them."""

import os
from urllib.parse import quote


def place(url):
    return os.path.join(os.environ["TEXTLOOM_TEST_WEB"], quote(url, safe=""))


def put(url, body, failures=0, status=200):
    with open(place(url), "wb") as f:
        f.write(f"{failures} {status}\n".encode() + (body if isinstance(body, bytes) else body.encode()))


def requests():
    """Each URL with how often it was asked for."""
    folder = os.environ["TEXTLOOM_TEST_WEB"]
    found = {}
    for name in os.listdir(folder):
        if name.endswith(".log"):
            with open(os.path.join(folder, name)) as f:
                for line in f:
                    found[line.strip()] = found.get(line.strip(), 0) + 1
    return found


def open_local(url, headers, timeout):
    """Breaks the connection as many times as the file says, then answers with its status."""
    asked = requests().get(url, 0)
    with open(os.path.join(os.environ["TEXTLOOM_TEST_WEB"], f"{os.getpid()}.log"), "a") as f:
        f.write(url + "\n")
    if not os.path.exists(place(url)):
        return 404, b"", None
    with open(place(url), "rb") as f:
        failures, status = map(int, f.readline().split())
        if asked < failures:
            raise ConnectionResetError("gone")
        return status, f.read(), "utf-8"
