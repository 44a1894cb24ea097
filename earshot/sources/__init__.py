"""Reading and writing: the event lake, history, master files, published tables."""
