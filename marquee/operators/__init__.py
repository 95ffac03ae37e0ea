"""Operators: DataFrame to DataFrame, or column ladders; rule tables and ``as_of`` are arguments."""
