"""Session helpers shared by every operator."""
