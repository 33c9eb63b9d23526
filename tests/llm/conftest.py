import re
from collections import defaultdict

import pytest

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def words():
    return lambda text: WORDS.findall((text or "").encode())


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


class Groups:
    """Union-find for the brute-force versions."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        self.parent[self.find(a)] = self.find(b)

    def smallest(self):
        members = defaultdict(list)
        for x in self.parent:
            members[self.find(x)].append(x)
        return {x: min(own) for own in members.values() for x in own}


@pytest.fixture
def groups():
    return Groups()
