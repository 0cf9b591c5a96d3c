def hello():
    print('world')
