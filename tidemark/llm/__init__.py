"""Training-data operators: one module per operator, shared pieces in
``common`` (text helpers, durable cuts) and ``linking`` (bucket linking and
connected components).  Nothing outside this package imports it."""
