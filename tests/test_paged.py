"""The paged source against a local service that fails, stalls, breaks off and repeats itself."""

import json
import threading
import time
import zlib
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from termspire import cli
from termspire.sources import corpus, paged

RECORDS = [
    {
        "PN": f"EP{i:05d}", "DETDL": ("en", "EN", "de", "fr")[i % 4], "IPC": ["A01B0001-0002 B02C0003-0004", "A01B0001-0002"],
        **({"CLMEN": [f"claim {i} one", "two\\nthree"]} if i % 3 else {}), **({"CLMDE": "Anspruch"} if i % 5 == 0 else {}),
        **({"DETD": [f"description {i}", "more\ttext"]} if i % 2 else {}),
    }
    for i in range(400)
]


class Service(ThreadingHTTPServer):
    daemon_threads = True

    def __init__(self, faults=True):
        super().__init__(("127.0.0.1", 0), Handler)
        self.faults, self.log, self.lock, self.seen, self.last = faults, [], threading.Lock(), Counter(), {}
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def url(self):
        return f"http://127.0.0.1:{self.server_port}"

    def handle_error(self, request, client_address):
        pass  # clients that gave up


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def answer(self, found, code=200, cut=False):
        data = json.dumps(found).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data[: len(data) // 2] if cut else data)

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])) or b"{}")
        service = self.server
        with service.lock:
            service.log.append((self.path, body))
            turn = service.seen[json.dumps(body, sort_keys=True)]
            service.seen[json.dumps(body, sort_keys=True)] += 1
        if self.path.startswith("/missing"):
            return self.answer({"error": "no such index"}, 404)
        if self.path.startswith("/busy"):
            return self.answer({}, 503)
        fault = (zlib.crc32(json.dumps(body, sort_keys=True).encode()) % 7) if service.faults and turn == 0 else 0
        if fault == 1:
            return self.answer({}, 503)
        if fault == 2:
            time.sleep(1.5)
        if fault == 3:
            return self.answer({"x": "y" * 100}, cut=True)
        if fault == 4:
            return self.answer({"timed_out": True, "hits": {"hits": []}})
        if self.path.startswith("/patents/_pit"):
            return self.answer({"id": "snapshot"})
        part = body.get("slice", {"id": 0, "max": 1})
        should = body["query"]["bool"]["should"]
        claims, lang = should[0]["exists"]["field"], should[1]["bool"]["filter"][0]["term"]["DETDL"]
        hit = lambda r: r.get(claims) is not None or (r["DETDL"].lower() == lang and r.get("DETD") is not None)
        own = [{"sort": [i], "_source": {k: v for k, v in r.items() if k in body["_source"]}} for i, r in enumerate(RECORDS) if i % part["max"] == part["id"] and hit(r)]
        after = body.get("search_after")
        page = [h for h in own if after is None or h["sort"] > after][: body["size"]]
        if fault == 5 and after:  # what came before comes again
            page = service.last.get((lang, part["id"]), page)
        service.last[lang, part["id"]] = page
        self.answer({"pit_id": "snapshot", "timed_out": False, "_shards": {"failed": 0}, "hits": {"hits": page}})


def rows(df):
    return sorted((r.pat_id, r.lang, r.claims, r.detd, tuple(r.ipc)) for r in df.collect())


@pytest.fixture
def files(tmp_path):
    as_list = lambda v: v if isinstance(v, list) else [v]
    (tmp_path / "records.json").write_text("\n".join(json.dumps({k: as_list(v) if k.startswith(("CLM", "DETD")) and k != "DETDL" else v for k, v in r.items()}) for r in RECORDS))
    return str(tmp_path / "records.json")


@pytest.mark.parametrize("slices", [1, 3])
def test_pages_equal_files(spark, files, slices):
    service = Service()
    for lang in ("en", "de"):
        got = paged.read_paged_documents(spark, service.url, "patents", lang, slices=slices, pageSize=7, timeout=1, pause=0.001)
        assert rows(got) == rows(corpus.read_json_documents(spark, files, lang)) != []
    assert {b["size"] for p, b in service.log if p == "/_search"} == {7}
    assert max(service.seen.values()) > 1 and {b.get("slice", {"max": 1})["max"] for p, b in service.log if p == "/_search"} == {slices}
    service.shutdown()


def test_language_is_part_of_the_request(spark):
    service = Service(faults=False)
    paged.register(spark)
    every = spark.read.format(paged.NAME).options(url=service.url, index="patents", slices=2, pause=0).load()
    some = every.where((F.col("lang") == "de") & F.col("PN").isNotNull())
    assert some.select("lang").distinct().collect()[0].lang == "de"
    asked = {json.dumps(b["query"]) for p, b in service.log if p == "/_search"}
    assert asked == {json.dumps(paged.language_query("de"))}
    before = len(service.log)
    assert every.where("lang = 'it'").count() == 0 and len(service.log) == before
    assert {r.lang for r in every.where("lang in ('de', 'fr')").select("lang").distinct().collect()} == {"de", "fr"}
    # A full last page is followed by an empty one, a short one by none.
    del service.log[:]
    n = sum(1 for r in RECORDS if r.get("CLMDE") or (r["DETDL"] == "de" and r.get("DETD")))
    read = lambda size: list(paged.pages(service.url, paged.Slice("de", 0, 1, "snapshot"), size, paged.Patience(1, 1, 0)))
    assert [len(p) for p in read(n)] == [n] and len(service.log) == 2
    assert [len(p) for p in read(n + 1)] == [n] and len(service.log) == 3
    service.shutdown()


def test_patience_ends():
    service, patience = Service(faults=False), paged.Patience(2, 1, 0)
    with pytest.raises(paged.Gone):
        paged.ask(f"{service.url}/busy/_search", {}, patience)
    assert len(service.log) == 3
    with pytest.raises(paged.urllib.error.HTTPError):
        paged.ask(f"{service.url}/missing/_search", {}, patience)
    assert len(service.log) == 4  # what won't pass isn't tried again
    service.shutdown()
    service.server_close()
    with pytest.raises(paged.Gone):
        paged.ask(f"{service.url}/patents/_search", {}, patience)
    for options in ({"url": "http://x"}, {"url": "http://x", "index": "y", "slices": "0"}):
        with pytest.raises(ValueError):
            paged.PagedReader(options)


def test_command_indexes_a_service(spark, files, tmp_path):
    service = Service(faults=False)
    common = ["index", "--lang", "en", "--analyzer", "bare"]
    a = cli.run(spark, [*common, "--index", str(tmp_path / "a"), "--source", f"{service.url}/patents", "--slices", "2", "--pause", "0"])
    b = cli.run(spark, [*common, "--index", str(tmp_path / "b"), "--source", files, "--json"])
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str) != []
    service.shutdown()
