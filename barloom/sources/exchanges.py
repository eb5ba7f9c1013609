"""Exchanges as Spark data sources.

A source's partitions are pages of a time range, so pages are fetched in parallel and a lost one is fetched again.
``transport`` gets a page's request and gives its payload; the default one speaks HTTP, another one may replay
recorded payloads (option ``replay``: a folder of JSON or CSV pages). Parsers turn payloads into candles.
"""

from __future__ import annotations

import csv
import hashlib
import hmac
import io
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from .shared import read_text

COLUMNS = "timestamp timestamp, open double, high double, low double, close double, volume double, source string, resolution string, market string, raw_data string"

# fixed values: minutes of a resolution, rows of a page, requests a second and hosts
MINUTES = {"1": 1, "5": 5, "15": 15, "30": 30, "60": 60, "120": 120, "240": 240, "360": 360, "1D": 1440}
PAGE = {"binance": 1000, "bitget": 1000, "coinbase": 300, "drift": 100_000}
RATE = {"drift": 10, "binance": 20, "coinbase": 15, "bitget": 20}
HOSTS = {
    "binance": "https://api.binance.com",
    "coinbase": "https://api.exchange.coinbase.com",
    "bitget": "https://api.bitget.com",
    "drift": "https://drift-historical-data-v2.s3.eu-west-1.amazonaws.com",
}
# fixed values: Drift's market keys
DRIFT_KEYS = {"SOL-PERP": "perp_0", "BTC-PERP": "perp_1", "ETH-PERP": "perp_2", "SOL": "spot_0"}


class ExchangeError(Exception):
    """A payload or request that can't be used."""


class RateLimitError(ExchangeError):
    """The exchange asks to wait."""


def moment(x: float) -> datetime:
    """Epoch seconds, or milliseconds if over ten digits, as UTC."""
    return datetime.fromtimestamp(x / 1000 if len(str(int(x))) > 10 else x, UTC).replace(tzinfo=None)


def _row(source: str, market: str, resolution: str, ts: float, values: list, raw: object) -> tuple:
    o, h, low, c, v = (float(x) for x in values)
    if v < 0:
        raise ExchangeError(f"negative volume at {ts}")
    return (moment(float(ts)), o, h, low, c, v, source, resolution, market, json.dumps(raw))


def parse_binance(payload: str, market: str, resolution: str) -> Iterator[tuple]:
    """Klines: rows of twelve values from the opening time in milliseconds on."""
    for r in json.loads(payload):
        yield _row("binance", market, resolution, r[0], r[1:6], r)


def parse_coinbase(payload: str, market: str, resolution: str) -> Iterator[tuple]:
    """Rows [seconds, open, high, low, close, volume], or objects with those names."""
    rows = json.loads(payload)
    rows = rows.get("candles", []) if isinstance(rows, dict) else rows
    for r in sorted(rows, key=lambda r: int(r["start"] if isinstance(r, dict) else r[0])):
        values = [r[k] for k in ("open", "high", "low", "close", "volume")] if isinstance(r, dict) else r[1:6]
        yield _row("coinbase", market, resolution, int(r["start"] if isinstance(r, dict) else r[0]), values, r)


def parse_bitget(payload: str, market: str, resolution: str) -> Iterator[tuple]:
    """Rows of milliseconds, open, high, low, close and volume, bare or under ``data``."""
    rows = json.loads(payload)
    for r in rows.get("data", []) if isinstance(rows, dict) else rows:
        yield _row("bitget", market, resolution, float(r[0]), r[1:6], r)


def parse_drift(payload: str, market: str, resolution: str) -> Iterator[tuple]:
    """CSV: ``start`` (milliseconds) or ``ts`` (seconds); prices of fills before others; volume of the base before others."""
    for r in csv.DictReader(io.StringIO(payload)):
        first = lambda *names: next((r[n] for n in names if r.get(n)), 0)  # noqa: B023, E731
        values = [first(f"fill{n.title()}", n) for n in ("open", "high", "low", "close")] + [first("baseVolume", "volume")]
        yield _row("drift", market, resolution, float(first("start", "ts")), values, r)


PARSERS: dict[str, Callable[[str, str, str], Iterator[tuple]]] = {
    "binance": parse_binance, "coinbase": parse_coinbase, "bitget": parse_bitget, "drift": parse_drift
}


def parse_ticker(payload: str, market: str, resolution: str, now: float) -> tuple:
    """A last trade as a candle without extent."""
    t = json.loads(payload)
    price = float(t["price"])
    ts = datetime.fromisoformat(t["time"].replace("Z", "+00:00")).timestamp() if t.get("time") else now
    return _row("coinbase", market, resolution, int(ts), [price] * 4 + [t.get("size") or 0], t)


def parse_markets(exchange: str, payload: str) -> list[str]:
    """Names BASE-QUOTE of the markets that trade."""
    data = json.loads(payload)
    if exchange == "binance":
        return [f"{s['baseAsset']}-{s['quoteAsset']}" for s in data["symbols"] if s["status"] == "TRADING"]
    if exchange == "coinbase":
        return [p["id"] for p in data if p["status"] == "online"]
    if exchange == "bitget":
        return [f"{s['baseCoin']}-{s['quoteCoin']}" for s in data["data"] if s.get("status", "online") == "online"]
    return list(DRIFT_KEYS)


def market_info(exchange: str, payload: str) -> list[tuple[str, str, str]]:
    """(market, base, quote) of the markets that trade."""
    return [(m, *(m.split("-", 1) if "-" in m else (m, ""))) for m in parse_markets(exchange, payload)]


def signature(secret: str, query: str) -> str:
    return hmac.new(secret.encode(), query.encode(), hashlib.sha256).hexdigest()


@dataclass
class Page(InputPartition):
    """A request: exchange, market, resolution and epoch seconds from first to last, both included."""

    exchange: str
    market: str
    resolution: str
    first: int
    last: int


def pages(exchange: str, markets: list[str], resolution: str, start: int, end: int) -> list[Page]:
    """Requests that cover the range of every market: by year for yearly files, else by as many bars as a page has."""
    out, step = [], MINUTES[resolution] * 60 * PAGE[exchange]
    for m in markets:
        if exchange == "drift":
            for year in range(moment(start).year, moment(end).year + 1):
                a, b = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in (year, year + 1))
                out.append(Page(exchange, m, resolution, max(a, start), min(b - 1, end)))
        else:
            out += [Page(exchange, m, resolution, a, min(a + step - 1, end)) for a in range(start, end + 1, step)]
    return out


def url(p: Page) -> str:
    query = urllib.parse.urlencode
    if p.exchange == "binance":
        return f"{HOSTS['binance']}/api/v3/klines?" + query(
            {
                "symbol": p.market,
                "interval": f"{MINUTES[p.resolution]}m",
                "startTime": p.first * 1000,
                "endTime": p.last * 1000,
                "limit": PAGE["binance"],
            }
        )
    if p.exchange == "coinbase":
        return f"{HOSTS['coinbase']}/products/{p.market}/candles?" + query(
            {"granularity": MINUTES[p.resolution] * 60, "start": p.first, "end": p.last}
        )
    if p.exchange == "bitget":
        return f"{HOSTS['bitget']}/api/v2/spot/market/candles?" + query(
            {
                "symbol": p.market,
                "granularity": f"{MINUTES[p.resolution]}min",
                "startTime": p.first * 1000,
                "endTime": p.last * 1000,
                "limit": PAGE["bitget"],
            }
        )
    key = DRIFT_KEYS.get(p.market, "perp_0")
    return f"{HOSTS['drift']}/market/{key}/candles/{p.resolution}/{moment(p.first).year}.csv"


class Http:
    """Requests no faster than the exchange allows, tried again after a wait."""

    def __init__(self, exchange: str, tries: int = 3):
        self.gap, self.last, self.tries = 1 / RATE[exchange], 0.0, tries

    def __call__(self, p: Page) -> str:
        for k in range(self.tries):
            time.sleep(max(0.0, self.last + self.gap - time.monotonic()))
            self.last = time.monotonic()
            try:
                with urllib.request.urlopen(url(p), timeout=30) as r:
                    return r.read().decode()
            except urllib.error.HTTPError as e:
                if e.code == 429 and k + 1 == self.tries:
                    raise RateLimitError(p.exchange) from e
                if (e.code != 429 and e.code < 500) or k + 1 == self.tries:
                    raise ExchangeError(str(e)) from e
                time.sleep(5)
            except OSError as e:
                if k + 1 == self.tries:
                    raise ExchangeError(str(e)) from e
                time.sleep(2**k)
        raise ExchangeError("no tries")


def latest_rows(rows: Iterator[tuple]) -> list[tuple]:
    """Of a payload's candles the one with the latest time; none of an empty one."""
    rows = sorted(rows, key=lambda r: r[0])
    return rows[-1:]


class Replay:
    """Recorded payloads: <folder>/<market>-<first second>.json or .csv, also of a shared store; a page without one is
    empty."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def __call__(self, p: Page) -> str:
        kind, empty = ("csv", "") if p.exchange == "drift" else ("json", "[]")
        found = read_text(f"{self.folder}/{p.market}-{p.first}.{kind}")
        return empty if found is None else found


def read_page(p: Page, transport: Callable[[Page], str]) -> Iterator[tuple]:
    """The page's candles inside its range, each time once."""
    seen = set()
    for row in PARSERS[p.exchange](transport(p), p.market, p.resolution):
        at = row[0].replace(tzinfo=UTC).timestamp()
        if p.first <= at <= p.last and at not in seen:
            seen.add(at)
            yield row


def latest(exchange: str, market: str, resolution: str, transport: Callable[[Page], str], now: float | None = None) -> list[tuple]:
    """The newest candle of a market: of the last page that a range up to now would have; none if that is empty."""
    now = int(now or time.time())
    first = int(datetime(moment(now).year, 1, 1, tzinfo=UTC).timestamp()) if exchange == "drift" else now - MINUTES[resolution] * 60 * PAGE[
        exchange
    ] + 1
    return latest_rows(read_page(Page(exchange, market, resolution, first, now), transport))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Page]:
        o = self.options
        return pages(o["exchange"], o["markets"].split(","), o.get("resolution", "60"), int(o["start"]), int(o["end"]))

    def read(self, partition: Page) -> Iterator[tuple]:
        transport = Replay(self.options["replay"]) if "replay" in self.options else Http(partition.exchange)
        yield from read_page(partition, transport)


class _Stream(SimpleDataSourceStreamReader):
    """Every bar that has closed since the last batch."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"at": int(self.options["start"])}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        o = self.options
        end = int(o.get("end", time.time()))
        return self._rows(start["at"], end), {"at": max(start["at"], end + 1)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start["at"], end["at"] - 1)

    def _rows(self, first: int, last: int) -> Iterator[tuple]:
        o = self.options
        transport = Replay(o["replay"]) if "replay" in o else Http(o["exchange"])
        found = []
        for p in pages(o["exchange"], o["markets"].split(","), o.get("resolution", "60"), first, last) if last >= first else []:
            found += list(read_page(p, transport))
        return iter(found)


class ExchangeSource(DataSource):
    """format("exchange"): options exchange, markets, resolution, start and end (epoch seconds), replay."""

    @classmethod
    def name(cls) -> str:
        return "exchange"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


def supported() -> list[str]:
    return sorted(PARSERS)
