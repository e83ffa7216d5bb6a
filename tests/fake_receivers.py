"""Receivers that append to a log in a folder; files beside the log make them fail."""

import fcntl
import json
import os
import uuid


class Box:
    def __init__(self, destination):
        self.dir = destination

    def log(self, **row):
        with open(self.dir + "/log", "a") as f:
            f.write(json.dumps(row) + "\n")

    def lines(self):
        try:
            with open(self.dir + "/log") as f:
                return [json.loads(x) for x in f]
        except FileNotFoundError:
            return []

    def send(self, key, text):
        with open(self.dir + "/lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            return self.sent(key, text)

    def sent(self, key, text):
        if os.path.exists(self.dir + "/kill") and self.lines():
            os._exit(1)
        if os.path.exists(self.dir + "/closed"):
            raise ConnectionError("closed")
        if os.path.exists(self.dir + "/shaky") and not os.path.exists(self.dir + "/tried-" + key[:8]):
            open(self.dir + "/tried-" + key[:8], "w").close()
            raise ConnectionError("again")
        if "refuse" in text:
            raise ValueError("refused")
        self.log(key=key, text=text)
        return "m" + key[:6]

    def find(self, key):
        pages = {}
        for x in self.lines():
            if x["do"] == "create":
                pages[x["key"]] = x["id"]
        return None if os.path.exists(self.dir + "/blind") else pages.get(key)

    def create(self, key, properties):
        page = uuid.uuid4().hex
        self.log(do="create", key=key, id=page, properties=properties)
        return page

    def update(self, page, properties):
        self.log(do="update", id=page, properties=properties)

    def archive(self, page):
        self.log(do="archive", id=page)


class Listing:
    def __init__(self, destination):
        self.dir = destination

    def page(self, cursor):
        with open(self.dir + "/log", "a") as f:
            f.write(str(cursor) + "\n")
        with open(self.dir + "/pages") as f:
            rows = json.load(f)
        at = int(cursor or 0)
        return [{"page_id": "p%d" % k, "key": "k%d" % k, "properties": {"n": k}} for k in rows[at:at + 3]], (str(at + 3) if at + 3 < len(rows) else None)
