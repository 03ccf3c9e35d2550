"""Message passing as joins and aggregations, and a bounded trainer."""
