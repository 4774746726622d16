"""HTML of one page as text, table grids and marked blocks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Classes of the title block and of the labels of groups, the attribute with an activity's id, the name of the buttons of hits.
TITLE_CLASS, GROUP_CLASS = "titulo_tabela_capa", "grupo-obrigacoes"
ID_ATTRIBUTE, HIT_BUTTON = "data-econet-id", "idcnae"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style"))
#: Columns and rows that one cell may span; markup that asks for more gets so many.
MOST_SPAN = 100


def clean(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


class Page(HTMLParser):
    """``text``, ``tables``, ``title``, ``groups`` and ``activity_id`` of a page; tags that are never closed end with what holds them.

    A table is (classes, rows); a row has its attributes, the value of its hit button, and its cells.  Tables inside of cells are tables
    of their own, and their text is text of the cell too.  A cell that spans columns or rows leaves empty cells there.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.words: list[str] = []
        self.tables: list[dict] = []
        self.groups: list[str] = []
        self.title: str | None = None
        self.activity_id: str | None = None
        self._open: list[dict] = []  # tables being read, outermost first
        self._blocks: list[dict] = []  # marked elements being read
        self._after_title: list[str] | None = None
        self._silent: str | None = None
        self.feed(html)
        self.close()
        while self._open:
            self._end_table()
        for block in self._blocks:
            self._end_block(block)
        self.text = clean(self.words)
        if self.title is None and self._after_title is not None:
            self.title = clean(self._after_title)

    def handle_starttag(self, tag, attrs):
        if self._silent:
            return
        if tag in SILENT:
            self._silent = tag
            return
        given = {k: v or "" for k, v in attrs}
        self._end_title()
        if self.activity_id is None and ID_ATTRIBUTE in given:
            self.activity_id = given[ID_ATTRIBUTE]
        for block in self._blocks:
            block["depth"] += tag == block["tag"]
        classes = given.get("class", "").split()
        if tag not in VOID and (GROUP_CLASS in classes or TITLE_CLASS in classes):
            self._blocks.append({"tag": tag, "depth": 1, "parts": [], "group": GROUP_CLASS in classes})
        if tag == "table":
            self._open.append({"classes": " ".join(classes), "rows": [], "row": None, "cell": None, "down": {}})
        elif self._open:
            at = self._open[-1]
            if tag == "tr":
                self._end_row(at)
                at["row"] = {"attributes": " ".join(f'{k}="{v}"' for k, v in given.items()), "button": None, "cells": []}
            elif tag in ("td", "th") and at["row"] is not None:
                self._end_cell(at)
                at["cell"] = {"parts": [], "head": tag == "th", "across": self._span(given.get("colspan")), "down": self._span(given.get("rowspan"))}
            elif tag == "input" and given.get("name") == HIT_BUTTON and at["row"] is not None and at["row"]["button"] is None:
                at["row"]["button"] = given.get("value", "")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self._silent:
            self._silent = None if tag == self._silent else self._silent
            return
        self._end_title()
        for block in [b for b in self._blocks if b["tag"] == tag]:
            block["depth"] -= 1
            if not block["depth"]:
                self._blocks.remove(block)
                self._end_block(block)
        if self._open:
            at = self._open[-1]
            if tag == "table":
                self._end_table()
            elif tag == "tr":
                self._end_row(at)
            elif tag in ("td", "th"):
                self._end_cell(at)

    def handle_data(self, data):
        if self._silent:
            return
        self.words.append(data)
        for at in self._open:
            if at["cell"] is not None:
                at["cell"]["parts"].append(data)
        for block in self._blocks:
            block["parts"].append(data)
        if self._after_title is not None and self.title is None:
            self._after_title.append(data)

    @staticmethod
    def _span(value: str | None) -> int:
        found = re.fullmatch(r"\s*(\d{1,6})\s*", value or "")
        return min(max(int(found[1]), 1), MOST_SPAN) if found else 1

    def _end_title(self) -> None:
        if self._after_title is not None and self.title is None:
            self.title = clean(self._after_title)

    def _end_block(self, block: dict) -> None:
        if block["group"]:
            self.groups.append(clean(block["parts"]))
        elif self._after_title is None:
            self._after_title = block["parts"]  # with the text up to the next tag

    def _end_cell(self, at: dict) -> None:
        cell, at["cell"] = at["cell"], None
        if cell is None or at["row"] is None:
            return
        cells, down = at["row"]["cells"], at["down"]
        while down.get(len(cells), 0) > 0:  # held by a cell above
            down[len(cells)] -= 1
            cells.append("")
        for i in range(cell["across"]):
            if cell["down"] > 1:
                down[len(cells)] = cell["down"] - 1
            if not cell["head"]:
                cells.append(clean(cell["parts"]) if i == 0 else "")

    def _end_row(self, at: dict) -> None:
        self._end_cell(at)
        if at["row"] is not None:
            at["rows"].append(at["row"])
            at["row"] = None

    def _end_table(self) -> None:
        at = self._open.pop()
        self._end_row(at)
        self.tables.append({"classes": at["classes"], "rows": at["rows"]})
