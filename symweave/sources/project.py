"""A project of source files written out from the nations and regions, for queries that scan, load and fetch files.

Each nation is a module with one function that calls its region and the next
nation of the region by name; each region is a module with a class of two
methods, of which the first calls the second. Both tables are covered whole.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from symweave.storage import local_folder, table


def identifier(name: str) -> str:
    return name.lower().replace(" ", "_")


def write_project(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a fresh copy of the project, in the shared folder; one small file a nation and region, written by the driver."""
    root = local_folder(spark, "project")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("r_name", "n_name").orderBy("r_name", "n_name").collect()  # a dimension of fixed size
    for at, (region, nation) in enumerate(rows):
        folder, name = os.path.join(root, identifier(region)), identifier(nation)
        os.makedirs(folder, exist_ok=True)
        following = rows[at + 1] if at + 1 < len(rows) and rows[at + 1][0] == region else None
        body = f"def {name}():\n    \"\"\"{nation} of {region}.\"\"\"\n    {identifier(region)}(1)\n" + (f"    {identifier(following[1])}()\n" if following else "")
        with open(os.path.join(folder, f"{name}.py"), "w", encoding="utf-8") as f:
            f.write(body)
        with open(os.path.join(root, f"{identifier(region)}.py"), "w", encoding="utf-8") as f:
            f.write(f"class {identifier(region)}_office:\n    def open(self):\n        self.close()\n\n    def close(self):\n        pass\n")
    return root
