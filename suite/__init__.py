"""The library's operators on the benchmark tables: one named case per operator."""
