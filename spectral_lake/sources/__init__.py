"""Sources: imaging files, frame databases, and views of other tables as spectra."""
