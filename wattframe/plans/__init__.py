"""Tables as compositions of operators (``silver``, ``gold``, ``reports``) and the
jobs that read, build and store them (``jobs``)."""
