"""Front ends: from the bytes of a source file to its definitions, references and imports."""
