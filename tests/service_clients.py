"""Clients that executors import by name."""

from pathlib import Path


class Mem0:
    def get_all(self, *, filters, page, page_size):
        rows = [{"id": f"{filters['user_id']}{i}", "memory": f"text {i}", "user_id": filters["user_id"]} for i in range(5)]
        return {"results": rows[(page - 1) * page_size : page * page_size], "next": page * page_size < len(rows) or None}


class Denied:
    def get_all(self, **_):
        raise type("AuthProblem", (Exception,), {})("no")


class FileGraph:
    """A group is a file with the number of its edges, so that it can grow between batches."""

    def edges(self, groups, *, limit, after, with_embeddings):
        rows = [{"uuid": f"{i:04}", "fact": f"fact {i}", "group_id": groups[0]} for i in range(int(Path(groups[0]).read_text()))]
        rest = [r for r in rows if after is None or r["uuid"] > after]
        if not rest:
            raise LookupError
        return rest[:limit]


file_graph = FileGraph
