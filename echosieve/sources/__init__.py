"""What the engine reads: files, archives, pictures, catalogues, dictionaries; and how it writes."""
