"""Analytics over semi-structured documents: lines, chords, sections, boxes and scores as DataFrames."""
