"""Downloads from a server of this machine, the font cache and temporary folders."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.error import HTTPError

import pytest
from test_ttf import font

from quire.sources import fetch, providers


class Handler(BaseHTTPRequestHandler):
    def _answer(self, status, body):
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        self._answer(*{"/up/health": (200, b"ok"), "/down/health": (503, b""), "/odd/health": (204, b""), "/a.ttf": (200, b"x" * 200_000)}.get(self.path, (404, b"")))

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        fine = b"PNG" in body and self.headers["Content-Type"].startswith("multipart/form-data; boundary=")
        self._answer(200, {"/ocr": b'{"success": true, "texts": ["a"]}', "/bad": b'{"success": false}'}[self.path] if fine else b"{}")

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_health(url):
    fetch.healthy(url + "/up/")
    with pytest.raises(HTTPError):
        fetch.healthy(url + "/down")
    with pytest.raises(ValueError):
        fetch.healthy(url + "/odd")


def test_recognition_client(url):
    assert providers.post_image(url + "/ocr", b"PNG")["texts"] == ["a"]
    with pytest.raises(ValueError):
        providers.post_image(url + "/bad", b"PNG")


def test_download_is_whole_or_nothing(url, tmp_path):
    assert fetch.fetched(url + "/a.ttf", tmp_path / "new" / "a.ttf").stat().st_size == 200_000
    old = tmp_path / "b.ttf"
    old.write_bytes(b"old")
    with pytest.raises(ValueError):
        fetch.fetched(url + "/a.ttf", old, most=199_999)
    with pytest.raises(HTTPError):
        fetch.fetched(url + "/none.ttf", tmp_path / "c.ttf")
    assert old.read_bytes() == b"old" and sorted(p.name for p in tmp_path.iterdir()) == ["b.ttf", "new"]


def test_only_missing_fonts_are_fetched(url, tmp_path):
    (tmp_path / "b.ttf").write_bytes(b"old")
    got = fetch.fetch_missing(url, tmp_path, ["a.ttf", "b.ttf", "c.ttf"])
    assert got["a.ttf"] == "" and "404" in got["c.ttf"] and set(got) == {"a.ttf", "c.ttf"}


def test_font_cache_tries_once():
    calls = []

    def load(script):
        calls.append(script)
        if script == "thai":
            raise OSError("none")
        return font() if script == "latin" else b"broken"

    cache = fetch.FontCache(load)
    assert [cache.get(s) is not None for s in ("latin", "thai", "cjk", "latin", "thai", "cjk")] == [True, False, False] * 2
    assert calls == ["latin", "thai", "cjk"]


def test_fresh_folder(tmp_path):
    (tmp_path / "job").mkdir()
    (tmp_path / "job" / "page").write_text("x")
    assert list(fetch.fresh_folder(tmp_path / "job", tmp_path).iterdir()) == []
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "out").symlink_to(tmp_path / "job")
    for bad in (tmp_path, tmp_path / "..", tmp_path / "root"):
        with pytest.raises(ValueError):
            fetch.fresh_folder(bad, tmp_path / "root")
    with pytest.raises(ValueError):
        fetch.fresh_folder(tmp_path / "root" / "out", tmp_path / "root")
    assert (tmp_path / "job").is_dir()
