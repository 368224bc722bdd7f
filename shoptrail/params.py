"""Parameters of an analysis task."""

from __future__ import annotations

import json
from dataclasses import dataclass

from shoptrail import constants as C


def _list(value: str | None) -> tuple[str, ...] | None:
    return None if value is None else tuple(value.split(","))


@dataclass(frozen=True)
class TaskParams:
    """Typed form of the JSON task parameter; an absent condition is None."""

    start_date: str | None = None
    end_date: str | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] | None = None
    cities: tuple[str, ...] | None = None
    sex: str | None = None
    keywords: tuple[str, ...] | None = None
    category_ids: tuple[str, ...] | None = None
    target_page_flow: tuple[int, ...] = ()

    @classmethod
    def from_json(cls, text: str) -> TaskParams:
        """Read an object of arrays; only the first element of each array counts, '' as absent."""
        raw = json.loads(text)

        def first(key: str) -> str | None:
            values = raw.get(key)
            return str(values[0]) if values and values[0] not in (None, "") else None

        def number(key: str) -> int | None:
            value = first(key)
            return None if value is None else int(value)

        return cls(
            start_date=first(C.PARAM_START_DATE),
            end_date=first(C.PARAM_END_DATE),
            start_age=number(C.PARAM_START_AGE),
            end_age=number(C.PARAM_END_AGE),
            professionals=_list(first(C.PARAM_PROFESSIONALS)),
            cities=_list(first(C.PARAM_CITIES)),
            sex=first(C.PARAM_SEX),
            keywords=_list(first(C.PARAM_KEYWORDS)),
            category_ids=_list(first(C.PARAM_CATEGORY_IDS)),
            target_page_flow=tuple(
                int(page) for page in (_list(first(C.PARAM_TARGET_PAGE_FLOW)) or ())
            ),
        )
