"""A small molecule kernel for Arrow-batched functions. It reads and writes molecule strings as labelled graphs; it knows
no aromaticity model, and its strings are not canonical."""
