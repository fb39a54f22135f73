"""Providers of the tests of paged sources."""

import os


class Numbered:
    """``pages`` pages of two items; the page named in ``flaky`` fails until its marker file is there, the one in ``broken`` always."""

    def __init__(self, options):
        self.o = options

    def fetch(self, category, page):
        if self.o.get("broken") == f"{category}/{page}":
            raise OSError("out of order")
        if self.o.get("flaky") == f"{category}/{page}":
            marker = os.path.join(self.o["marks"], f"{category}-{page}")
            if not os.path.exists(marker):
                open(marker, "w").close()
                raise OSError("try again")
        return [f"{category}{page}{x}" for x in "ab"] if page <= int(self.o["pages"]) else None
