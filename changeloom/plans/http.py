"""A small HTTP front of a store: GET /get?key=K and PUT /put?key=K with the value as the body.

For operating and demonstration; single lookups cost a Spark job each. Bulk access is `Store.multi_get`
and `Store.write`. One store and one lock take the place of a replicated log.
"""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .store import Store


def server(store: Store, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is not yet running; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: bytes = b"") -> None:
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _key(self, path: str) -> bytes | None:
            url = urlsplit(self.path)
            if url.path != path:
                self._answer(404)
                return None
            key = parse_qs(url.query).get("key", [""])[0].encode()
            if not key:
                self._answer(400, b"missing key")
                return None
            return key

        def do_GET(self) -> None:
            if (key := self._key("/get")) is not None:
                try:
                    value = store.get(key)
                except Exception as e:  # noqa: BLE001  any failure is a 500, never "not found"
                    return self._answer(500, str(e)[:200].encode())
                self._answer(404, b"key not found") if value is None else self._answer(200, value)

        def do_PUT(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if (key := self._key("/put")) is not None:
                try:
                    store.put(key, body)
                except Exception as e:  # noqa: BLE001
                    return self._answer(500, str(e)[:200].encode())
                self._answer(200)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main(args: list[str] | None = None) -> None:
    """Serves a store until it is stopped: python -m changeloom.plans.http ROOT [--host H] [--port P]."""
    import argparse

    from pyspark.sql import SparkSession

    cli = argparse.ArgumentParser(prog="changeloom.plans.http")
    cli.add_argument("root", help="folder of the store")
    cli.add_argument("--host", default="127.0.0.1")
    cli.add_argument("--port", type=int, default=8080)
    asked = cli.parse_args(args)
    store = Store(SparkSession.builder.appName("changeloom").getOrCreate(), asked.root)
    web = server(store, asked.host, asked.port)
    print(f"serving {asked.root} at http://{asked.host}:{web.server_address[1]}", flush=True)
    try:
        web.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        web.server_close()
        store.close()


if __name__ == "__main__":
    main()
