"""The parameters of a profit search, and their URL form."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from urllib.parse import parse_qs, urlencode

MEASURES = ("roi", "profit", "tx", "tx7", "psaTx", "psaTx7", "chg30", "chg7", "psa", "psaMin", "price", "listings", "days", "updated", "tvel")
DECISIONS = ("valuable", "watch", "avoid")


@dataclass(frozen=True)
class ProfitQuery:
    fee: float = 13000.0
    guide: str = "70"
    tx: float = 30.0
    txMax: float | None = None  # noqa: N815  (the names are those of the URL)
    tx7: float = 0.0
    tx7Max: float | None = None  # noqa: N815
    psaTx: float = 0.0  # noqa: N815
    psaTxMax: float | None = None  # noqa: N815
    psaTx7: float = 0.0  # noqa: N815
    psaTx7Max: float | None = None  # noqa: N815
    roi: float = 40.0
    psaMin: float = 0.0  # noqa: N815
    psaMax: float | None = 200000.0  # noqa: N815
    priceMin: float | None = None  # noqa: N815
    priceMax: float | None = None  # noqa: N815
    sort: str = "roi-desc"
    q: str = ""
    hide: tuple[str, ...] = ()
    showCalc: bool = True  # noqa: N815
    limit: int = 60

    @classmethod
    def from_url(cls, text: str) -> ProfitQuery:
        """Reads a query string; values that aren't valid leave the default."""
        given = {k: v[-1] for k, v in parse_qs(text.lstrip("?"), keep_blank_values=True).items()}
        out = cls()
        for f in fields(cls):
            if f.name not in given or f.name == "limit":
                continue
            v = given[f.name].strip()
            if f.name == "guide":
                out = replace(out, guide=v) if v in ("70", "50") else out
            elif f.name == "sort":
                out = replace(out, sort=v) if v in {f"{m}-{d}" for m in MEASURES for d in ("asc", "desc")} else out
            elif f.name == "q":
                out = replace(out, q=v)
            elif f.name == "hide":
                out = replace(out, hide=tuple(d for d in DECISIONS if d in {x.strip() for x in v.split(",")}))
            elif f.name == "showCalc":
                out = replace(out, showCalc=v != "0")
            else:
                try:
                    n = float(v)
                except ValueError:
                    continue
                if n == n and abs(n) != float("inf") and (n >= 0 or f.name.startswith("price")):
                    out = replace(out, **{f.name: n})
        return out

    def to_url(self) -> str:
        """A query string of what differs from the defaults, in the order of the fields."""
        shown = {}
        for f in fields(self):
            v = getattr(self, f.name)
            if v == f.default or v is None or f.name == "limit":
                continue
            shown[f.name] = ",".join(v) if f.name == "hide" else ("1" if v else "0") if isinstance(v, bool) else f"{v:g}" if isinstance(v, float) else v
        return urlencode(shown)
