"""Named queries over the test tables, each with the DuckDB SQL of the same result where SQL can say it."""
