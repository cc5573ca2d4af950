"""Where rows come from and go to: files, PDF documents, JSON."""
